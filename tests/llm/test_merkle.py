"""Hash trees against a plain recursive build."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventlens.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(digests, arity):
    """The root, and the siblings left and right of each leaf, level by level."""
    steps = [[] for _ in digests]
    groups = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        upper, merged = [], []
        for a in range(0, len(digests), arity):
            run = digests[a : a + arity]
            for k, group in enumerate(groups[a : a + arity]):
                for leaf in group:
                    steps[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            upper.append(sha("".join(run)))
            merged.append(sum(groups[a : a + arity], []))
        digests, groups = upper, merged
    return digests[0], steps


def trees_of(rows, arity=8):
    """``(tree, id, leaf) -> (subroot, root, steps)`` of rows (tree, id, leaf)."""
    trees = defaultdict(list)
    for tree, i, leaf in rows:
        trees[tree].append((i is not None, i or 0, leaf))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: climb([r[2] for r in sorted(trees[t])], arity) for t in order}
    root, upper = climb([built[t][0] for t in order], arity)
    out = []
    for k, t in enumerate(order):
        for (some, i, leaf), steps in zip(sorted(trees[t]), built[t][1], strict=True):
            out.append((t, i if some else None, leaf, built[t][0], root, steps + upper[k]))
    return out


@pytest.mark.parametrize(("arity", "depth"), [(8, 3), (2, 1), (3, 2)])
def test_manifest(spark, arity, depth):
    rng = random.Random(arity)
    rows = [(t, rng.randrange(400) if rng.random() < 0.95 else None, sha(str(rng.randrange(500)))) for t in ["a", "b", "é", "B"] + ["a"] * 6 for _ in range(30)]
    rows += [(None, 1, sha("x")), ("alone", 5, sha("y"))] + [(f"t{k}", k, sha(str(k))) for k in range(12)]
    leaves = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "tree string, item long, leaf string, witness int").repartition(5)
    found = merkle.manifest(leaves, "tree", "item", "leaf", arity, depth)
    got = [(r["item"]["tree"], r["item"]["item"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["witness"]]) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, trees_of(rows, arity)))
    assert found.filter(merkle.fold("leaf", "witness") != F.col("root")).count() == 0
    assert found.filter(merkle.fold(F.sha2("leaf", 256), "witness") == F.col("root")).count() == 0
    assert sorted(r[0] for r in found.select("item.witness").collect()) == list(range(len(rows)))


def test_one_and_no_leaf(spark):
    leaves = spark.createDataFrame([(None, 1, sha("x"))], "tree string, id long, leaf string")
    (row,) = merkle.manifest(leaves, "tree", "id", "leaf").collect()
    assert row["leaf"] == row["subroot"] == row["root"] == sha("x") and row["witness"] == []
    assert merkle.manifest(leaves.filter("false"), "tree", "id", "leaf").count() == 0


def test_streams_close_alike():
    """A stream of whole blocks whose roots are appended to another is the tree of all leaves."""
    digests = [sha(str(k)) for k in range(100)]
    root, steps = climb(digests, 2)
    blocks = []
    for a in range(0, 100, 16):
        stream = merkle.Stream(4, 2)
        nodes = [stream.append(d) for d in digests[a : a + 16]]
        blocks.append((stream.close().digest, nodes))
    upper = merkle.Stream(3, 2)
    tops = [upper.append(d) for d, _ in blocks]
    assert upper.close().digest == root
    assert [n.witness() + top.witness() for (_, nodes), top in zip(blocks, tops, strict=True) for n in nodes] == steps


def test_query(spark, odd_docs, tmp_path):
    rows = [(i, "en" if i % 3 else "fr", "src", i, f"Text Number {i} é") for i in range(700)]
    rows += [(i, "de", None, None, None) for i in range(3)]
    columns = ["doc_id", "lang", "source", "n_chars", "text"]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    docs.unionByName(odd_docs.select(columns)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows += [tuple(r) for r in odd_docs.select(columns).collect()]

    def leaf(row, change=lambda t: t):
        fields = [row[0], row[2], row[1], row[3], change(row[4]) if row[4] is not None else None]
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    lowered = {leaf(r): leaf(r, lambda t: "".join(c.lower() if c < "\x80" else c for c in t)) for r in rows}
    want = []
    for _, i, own, subroot, root, steps in trees_of([(r[1], r[0], leaf(r)) for r in rows]):
        tampered = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        h = lowered[own] if tampered else own
        for a, b in steps:
            h = sha(a + h + b)
        want.append((i, own, subroot, root, sha("".join(a + b for a, b in steps)), h, h == root))
    got = list(map(tuple, queries.op12_merkle_manifest(spark, str(tmp_path)).collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[-1] for r in got} == {True, False}

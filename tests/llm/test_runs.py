"""Periodic runs against a brute force that knows nothing of trees."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from eventlens.llm import queries, runs

from .conftest import prose


def brute(words, least=24, power=3):
    """Every stretch in which words ``q`` apart are equal; of one stretch the smallest period."""
    known, best = {}, {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    for q in range(1, len(words) // power + 1):
        same = np.concatenate([[False], numbers[q:] == numbers[:-q], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for s, e in zip(turns[::2], turns[1::2], strict=True):
            if e - s + q >= max(least, power * q):
                best.setdefault((s, e - s + q), q)
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def left(words, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng):
    words, kinds = [], rng.choice([1, 2, 3, 6])
    for _ in range(rng.randint(1, 12)):
        part = ["ab c d ée f".split()[rng.randrange(min(kinds, 5))] for _ in range(rng.randint(1, 14))]
        words += part * rng.choice([1, 1, 2, 3, 5])
    return words


@pytest.mark.parametrize(("least", "power"), [(24, 3), (4, 2), (7, 3), (6, 6)])
def test_runs_of_words(least, power):
    rng = random.Random(least)
    for _ in range(400):
        words = periodic(rng)
        assert runs.runs_of(words, least, power) == brute(words, least, power)
    assert runs.runs_of([], least, power) == []


def test_agreement_of_suffixes():
    rng = random.Random(2)
    for _ in range(50):
        s = [rng.randint(1, 3) for _ in range(rng.randint(2, 60))] + [0]
        tree = runs.SuffixTree(s, 4)
        assert tree.rank.tolist() == [sorted(range(len(s)), key=lambda i: s[i:]).index(i) for i in range(len(s))]
        pairs = [(a, b) for a in range(len(s)) for b in range(len(s)) if a != b]
        want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in pairs]
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        assert tree.agree(a, b).tolist() == want


def test_segments_lose_nothing():
    """Texts side by side, some periodic: every run is found, in its own text."""
    rng = random.Random(5)
    for least, power in ((24, 3), (8, 2)):
        texts = [periodic(rng) if rng.random() < 0.6 else prose(rng, 3).split() for _ in range(300)]
        texts += [[], ["one"], ["x"] * 100, ["x"] * 100, ["a", "b"] * 40 + ["c"] + ["a", "b"] * 40]
        # a repeated stretch that is no run, next to one that is
        texts.append([f"w{i}" for i in range(30)] * 2 + ["t", "u"] * 20)
        found = runs.find([" ".join(t).encode() for t in texts], least, power)
        assert found == [brute(t, least, power) for t in texts]


def test_periods_of_any_length():
    period = [f"w{i}" for i in range(3000)]
    assert runs.find([" ".join(["a", *period * 4, "w0", "b"]).encode()]) == [[(1, 12001, 3000)]]


def test_collapse(spark, odd_docs, no_docs):
    rng = random.Random(3)
    rows = [(i, " ".join(periodic(rng))) for i in range(80)] + [(80, prose(rng, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", runs.collapse("text").alias("x")).collect()}
    for i, text in rows:
        want = brute(text.split())
        assert [tuple(r) for r in got[i]["runs"]] == want
        assert got[i]["collapsed"] == left(text.split(), want)
    odd = odd_docs.select("n", "text", runs.collapse("text").alias("x")).collect()
    assert len(odd) == odd_docs.count()
    for r in odd:
        assert r["x"]["collapsed"] == " ".join((r["text"] or "").split())
        assert r["x"]["runs"] == []
    assert no_docs.select(runs.collapse("text")).count() == 0


def test_query(spark, odd_docs, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(periodic(rng)) if i % 2 else prose(rng, 9)) for i in range(200)] + [(201, None), (202, "")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    own.unionByName(odd_docs.select("doc_id", "text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = []
    for i, text in rows:
        words, h = (text or "").split(), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = brute(words)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, left(words, found)))
        want.append((i, len(found), *best, milli, *digests))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

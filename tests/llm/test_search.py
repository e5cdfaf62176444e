"""Neighbours, licences and tool calls."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import chat, licences, neighbours, queries
from eventlens.llm.licences import PHRASES, Scanner, compile_template


def exact(rows, queries, k):
    out = {}
    for q, v in rows:
        if q in queries:
            scores = [(-float(np.dot(v, x) / np.sqrt(np.dot(v, v) * np.dot(x, x))), i) for i, x in rows if i != q]
            out[q] = sorted(scores)[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 1500)] + 0.7 * rng.normal(size=(1500, 24))
    x[100:400] = x[100]  # one very common vector
    return [(i, v) for i, v in enumerate(x)]


@pytest.mark.parametrize("blocks", [(16_384, 1024), (100, 3)])
def test_neighbours_recall(spark, vectors, blocks):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<double>").repartition(5)
    found = neighbours.nearest(frame, F.col("id") % 50 == 0, row_block=blocks[0], query_block=blocks[1]).collect()
    want = exact(vectors, set(range(0, 1500, 50)), 5)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r)
    assert got.keys() == want.keys()
    hits = 0
    by_id = dict(vectors)
    for q, rows in got.items():
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        for r in rows:
            v, x = by_id[q], by_id[r["vec_id"]]
            assert abs(r["score"] - v @ x / np.sqrt((v @ v) * (x @ x))) < 1e-12
        # a row as near as the fifth counts
        hits += sum(r["score"] >= -want[q][4][0] - 1e-9 for r in rows)
    assert hits / (5 * len(want)) >= 0.9


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1e300, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, bucket int")
    found = neighbours.nearest(frame, F.col("id") % 50 == 0).collect()
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert got[0] == [9, 50, 8]
    assert sorted(got[50]) == [0, 8, 9]  # fewer than five: all of them
    assert neighbours.nearest(frame.filter("false"), F.col("id") % 50 == 0).count() == 0
    assert neighbours.nearest(frame.filter("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_rotation_keeps_angles():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 24))
    y = neighbours.rotate(x, 3)
    assert y.shape == (20, 32)
    assert np.allclose(x @ x.T, y @ y.T)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licence_phrases(spark, odd_docs, no_docs, some_docs):
    rng = random.Random(3)
    pieces = ["CC BY", "cc-by", "ccby", "cc bye", "General\nPublic  License", "all rights reserved", "All Rights", "cc by cc by", "é", "by", "x9"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [t for _, t in some_docs] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = frame.select("text", licences.licences("text").alias("f")).select("text", "f.*").collect()
    for r in found:
        assert tuple(r[1:6]) == base_of(r["text"])
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    odd = odd_docs.select("*", licences.licences("text").alias("f")).collect()
    assert [r["f"]["labels"] for r in odd if r["text"] and "Licensed" in r["text"]] == ["cc-by,cc-by-nc-4.0"]
    assert no_docs.select(licences.licences("text")).count() == 0


@pytest.mark.parametrize(("text", "labels"), [
    ("x Licensed under the Apache License, Version 2.0. y", "apache-2.0"),
    ("This work is licensed under the terms of the Apache License 2.0", "apache-2.0"),
    ("licensed under the Apache License, Release 2.0", ""),
    ("Released under the MIT License.", "mit"),
    ("Released under MIT License.", ""),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Copyright (c) 2019 A B. All rights reserved.", "copyright,reserved"),
    ("Copyright all rights reserved", "reserved"),
    ("Copyright 1 2 3 4 5 6 7 8 9 all rights reserved", "reserved"),
])
def test_templates(text, labels):
    scanner = Scanner(PHRASES, licences.TEMPLATES)
    assert [row[5] for row in scanner.scan([text.encode(), b"", text.encode()])] == [labels, "", labels]


def words_of(template, rng):
    """A wording that the template allows."""
    out, skip = [], 0
    for part in template.replace("[", " [ ").replace("]", " ] ").split():
        if part == "[":
            skip = skip + 1 if skip or rng.random() < 0.5 else 0
        elif part == "]":
            skip = max(0, skip - 1)
        elif not skip:
            if "," in part:
                low, high = map(int, part[1:-1].split(","))
                out += [rng.choice("abc") for _ in range(rng.randint(low, high))]
            else:
                out.append(rng.choice(part.strip("{}").split("|")))
    return out


@pytest.mark.parametrize("template", [*licences.TEMPLATES.values(), "a [b [c] d] {0,2} e", "[a] {x|y} {2,3} z [q]"])
def test_automaton_accepts_exactly_its_wordings(template):
    rng = random.Random(1)
    scanner = Scanner({}, {"t": template})
    auto = compile_template(template)
    for _ in range(60):
        words = words_of(template, rng)
        assert list(scanner.scan([" ".join(words).encode()]))[0][5] == "t"
        assert auto.demanded <= set(words)
        demanded = [i for i, w in enumerate(words) if w in auto.demanded and words.count(w) == 1]
        if demanded:  # another word in a mandatory place is not accepted
            words[rng.choice(demanded)] = "wrong"
            assert list(scanner.scan([" ".join(words).encode()]))[0][5] == ""


CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>, id int"
RESULTS = "conv_id long, turn long, call_id string, content string, r int"
FIELDS = "tool string, field string, type string, required boolean, least double, most double"


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "find", '{"q": "x", "n": 3}', [], 1),
        (1, 2, "b", "find", '{"n": 30, "q": ""}', ["a", "unknown"], 1),
        (1, 4, "c", "find", '{"n": "3", "z": {"y": 1, "x": [1, 2.5]}}', ["a", "b"], 1),
        (1, 6, "c", "find", "{}", None, 1), (1, 6, "c", "find", "{}", None, 1),
        (2, 0, "d", "none", "{}", ["e"], 1), (2, 2, "e", "find", "not json", ["d"], 1), (2, 4, "f", "find", None, ["e"], 1),
        (3, 0, None, "find", "[1]", [], 1), (3, 0, "g", None, '{"q":"a","n":1}', None, 1),
    ]
    results = [(1, 3, "a", "late", 1), (1, 1, "a", '{"b":1, "a":2}', 1), (1, 3, "b", None, 1), (1, 5, "zz", "x", 1), (1, 5, None, "y", 1)]
    fields = [("find", "q", "string", True, 1.0, None), ("find", "n", "integer", False, 1.0, 10.0), ("find", "q", "string", True, 1.0, None)]
    linked = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(fields, FIELDS)).collect()
    got = sorted(((r["call_id"], r["status"], r["level"], r["n_results"], tuple(r["errors"]), r["arguments"], r["result"]) for r in linked), key=repr)
    assert got == sorted([
        ("a", "linked", 0, 2, (), '{"n":3,"q":"x"}', '{"a":2,"b":1}'),
        ("b", "linked", 1, 1, ("n: range", "q: length"), '{"n":30,"q":""}', '{"text":null}'),
        ("c", "unanswered", 2, 0, ("n: not integer", "q: missing", "z: not a field"), '{"n":"3","z":{"x":[1,2.5],"y":1}}', None),
        ("c", "duplicate", None, 0, ("q: missing",), "{}", None), ("c", "duplicate", None, 0, ("q: missing",), "{}", None),
        ("d", "cycle", None, 0, ("unknown tool",), "{}", None), ("e", "cycle", None, 0, ("not JSON",), None, None),
        ("f", "cycle", None, 0, ("not JSON",), None, None), (None, "no id", None, 0, ("not an object",), "[1]", None),
        ("g", "unanswered", 0, 0, ("unknown tool",), '{"n":1,"q":"a"}', None),
        ("zz", "orphan", None, 1, (), None, '{"text":"x"}'), (None, "orphan", None, 1, (), None, '{"text":"y"}'),
    ], key=repr)


def test_no_tool_calls(spark):
    empty = [spark.createDataFrame([], s) for s in (CALLS, RESULTS, FIELDS)]
    assert chat.link(*empty).count() == 0


def test_levels_of_a_chain(spark):
    rng = random.Random(6)
    n = 12
    deps = {i: rng.sample(range(i), min(i, rng.randint(0, 3))) for i in range(n)}
    want = {}
    for i in range(n):
        want[i] = max((want[d] + 1 for d in deps[i]), default=0)
    rows = [(str(i), [str(d) for d in deps[i]]) for i in rng.sample(range(n), n)]
    found = chat.levels(spark.createDataFrame(rows, "call_id string, depends_on array<string>")).collect()
    assert {int(r["call_id"]): r["level"] for r in found} == want


def test_levels_of_a_long_chain(spark):
    rows = [(str(i), [str(i - 1)]) for i in range(300)] + [("x", ["299", "7"]), ("y", ["x"]), ("c", ["d"]), ("d", ["c"]), ("e", ["c", "3"])]
    found = chat.levels(spark.createDataFrame(rows, "call_id string, depends_on array<string>")).collect()
    want = {str(i): i for i in range(300)} | {"x": 300, "y": 301}
    assert {r["call_id"]: r["level"] for r in found} == want


def test_canonical_json(spark):
    values = ['{"b": [1, {"d":null,"c":true}], "a": "é\\n\\"/"}', "{", None, '"x"', "12", '{"a":1,"a":2}']
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[1] for r in frame.select("i", chat.canonical_json(F.col("v"))).orderBy("i").collect()]
    assert json.loads(got[0]) == json.loads(values[0])
    assert got[0] == json.dumps(json.loads(values[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[1:] == [None, None, '"x"', "12", None]


def test_chat_query_keeps_whole_texts(spark, tmp_path):
    texts = ["a short turn" * 2, "a long turn with \"quotes\" and more than forty" + " letters" * 3]
    texts = [t + "." * (-len(t) % 3) for t in texts]
    rows = [(c, turn, role, t) for c, t in enumerate(texts) for turn, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted(queries.op1_chat(spark, str(tmp_path)).collect(), key=lambda r: r["conv_id"])
    assert [json.loads(r["arguments"])["query"] for r in found] == texts
    assert ["query: length" in r["errors"] for r in found] == [False, True]

"""Backoff scores against counts in dictionaries, token by token."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import queries, scoring


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Plain:
    """Smoothed n-grams from counts of all training texts; ``0`` stands before a text, ``None`` ends it."""

    def __init__(self, texts, order):
        self.order, self.count, self.texts = order, Counter(), texts
        for text in texts:
            for gram in self.grams(text):
                self.count.update(gram[i:] for i in range(len(gram)) if gram[i:] != (0,))
        words = [c for g, c in self.count.items() if len(g) == 1]
        self.n, self.v = sum(words), len(words)

    def grams(self, text):
        row = [0, *tokens(text)]
        return [tuple(row[max(0, i - self.order + 1) : i + 1]) for i in range(1, len(row))]

    def p(self, gram, k, less=0):
        own = max(self.count[gram] - less, 0)
        if len(gram) == 1:
            return (own + 0.5) / (max(self.n - less, 0) + 0.5 * (self.v + 1))
        before = len(self.texts) if gram[:-1] == (0,) else self.count[gram[:-1]]
        return (own + k * self.p(gram[1:], k, less)) / (max(before - less, 0) + k)

    def score(self, text, k):
        return sum(math.log10(self.p(g, k)) for g in self.grams(text))

    def strength(self, strengths):
        return max(strengths, key=lambda k: sum(math.log10(self.p(g, k, 1)) for t in self.texts for g in self.grams(t)))

    def row(self, text, k):
        words = [g[-1:] for g in self.grams(text)]
        base = sum(math.log10((self.count[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in words)
        return len(words), sum(self.count[w] > 0 for w in words), self.n, base, self.score(text, k)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = "a B c D e f gg é 漢 hh i j k".split()
    rows = []
    for i in range(150):
        n, text = rng.choice([0, 1, 2, 9, 60, 1200]), []
        while len(text) < n:
            text += rng.choice([["x", "y", "z"], ["y", "x"], [rng.choice(words)], [f"w{rng.randrange(3000)}"]])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text), rng.random() < 0.7))
    return rows


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:-2] == b[:-2] and a[-2:] == pytest.approx(b[-2:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("order", "block", "grams"), [(3, 1 << 20, 10**6), (3, 2000, 500), (1, 9000, 10**4), (2, 9000, 10**4), (4, 9000, 900)])
def test_scores(spark, rows, order, block, grams):
    plain = Plain([t for _, t, train in rows if train], order)
    k = plain.strength(scoring.STRENGTHS)
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    found = scoring.score(docs, F.col("train"), order=order, block_bytes=block, range_grams=grams)
    same([tuple(r) for r in found.collect()], [(i, train, *plain.row(t, k)) for i, t, train in rows])


def test_every_state_adds_up_to_one():
    plain = Plain(["a b a c", "a b", "c c a b a c", ""], 3)
    known = [g[0] for g in plain.count if len(g) == 1] + ["never seen"]
    for context in [(), (0,), ("a",), ("a", "b"), (0, "a"), ("b", "b"), ("never seen",)]:
        assert sum(plain.p((*context, w), 4.0) for w in known) == pytest.approx(1)


def test_numbers_pack():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        values = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert (scoring.unpack(scoring.pack(values)) == values).all()
        assert (scoring.unpack_sorted(scoring.pack_sorted(np.sort(values))) == np.sort(values)).all()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"], (r["doc_id"] or 0) % 3 > 0) for r in odd_docs.collect()]
    plain = Plain([t for _, t, train in rows if train], 3)
    found = scoring.score(odd_docs, F.col("doc_id") % 3 > 0, block_bytes=1000)
    k = plain.strength(scoring.STRENGTHS)
    same([tuple(r) for r in found.collect()], [(i, train, *plain.row(t, k)) for i, t, train in rows])
    assert scoring.score(no_docs, F.lit(True)).count() == 0
    untrained = scoring.score(odd_docs, F.lit(False)).collect()
    assert len(untrained) == len(rows) and {(r["train_tokens"], r["n_known"], r["score"]) for r in untrained} == {(0, 0, 0.0)}


def test_query(spark, rows, odd_docs, tmp_path):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    docs.unionByName(odd_docs.select("doc_id", "text")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    every = [r[:2] for r in rows] + [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    held = [(i, t, i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in every]
    plain = Plain([t for _, t, out in held if not out], scoring.ORDER)
    k = plain.strength(scoring.STRENGTHS)
    got = [tuple(r) for r in queries.op11_backoff_scores(spark, str(tmp_path)).collect()]
    same(got, [(i, out, *plain.row(t, k)) for i, t, out in held])
    assert sum(r[-1] for r in got if r[1]) > sum(r[-2] for r in got if r[1])  # better than single tokens on unseen texts

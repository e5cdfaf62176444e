"""Exact event clusters where neighbours need no common term, against the distances of all pairs."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from eventlens.operators import events, similar

from .brute import clusters, cosine, tfidf

START = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def tweets():
    """Bursts, quiet days, copies in one hour and over days, equal times, texts that share nothing."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows, hour = [], 0.0
    while len(rows) < 150:
        hour += rng.choice([0.0, 0.01, 0.5, 3.0, 9.0, 20.0])
        text = rng.choices(words[: rng.choice([6, 60])], k=rng.randint(1, 6))
        for _ in range(rng.choice([1, 1, 1, 6])):
            rows.append((text, hour + rng.choice([0, 0, 1, 30])))
    return [(i, t, START + dt.timedelta(hours=h)) for i, (t, h) in enumerate(rows)]


@pytest.mark.parametrize(
    ("eps", "options"),
    [
        (0.5, {}), (0.55, {}), (0.55, {"border": "min", "leaf_pairs": 4}), (0.55, {"index_from": 0.6}),
        (0.7, {"index_from": 0.05, "leaf_pairs": 1}), (0.5, {"time_decay": "off"}), (1.0, {}),
    ],
)
def test_wide_clusters(spark, tweets, eps, options):
    df = spark.createDataFrame(tweets, "id bigint, words array<string>, created_at timestamp").repartition(3)
    min_pts = 6
    got = events.event_clusters(df, min_pts, eps, candidates="exact", score_tokens=F.col("words"), **options)
    vectors = {i: v for i, v in tfidf({r[0]: r[1] for r in tweets if len(r[1]) >= 2}).items() if v}
    times = {r[0]: r[2] for r in tweets}
    decay = options.get("time_decay") != "off"
    pairs = []
    for a, b in itertools.combinations(sorted(vectors), 2):
        apart = abs((times[a] - times[b]).total_seconds()) / 3600
        time = 1 - min(apart / 72, 1) if decay else 1.0
        if round(1 - time * (cosine(vectors[a], vectors[b]) + 1) / 2, 9) <= eps:
            pairs.append((a, b))
    want = clusters(list(vectors), pairs, lambda n: n > min_pts, options.get("border", "bridge"), own=1)
    assert {r["id"]: (r["n"], r["core"], r["cluster"]) for r in got.points.collect()} == want
    assert len({c for _, _, c in want.values()}) > 1 or not decay or eps > 0.55


def test_no_tweets(spark):
    none = spark.createDataFrame([], "id bigint, words array<string>, created_at timestamp")
    got = events.event_clusters(none, 3, 0.55, candidates="exact", score_tokens=F.col("words"))
    assert got.points.count() == 0


@pytest.mark.parametrize("heavy_rows", [20_000, 7])
def test_band_pairs(spark, heavy_rows):
    """Pairs in the band and no others, also where one slot is laid out in parts."""
    rng = random.Random(1)
    rows = []
    for i in range(120):
        lo = rng.choice([5.0, rng.uniform(0, 60)])
        weights = {t: rng.uniform(0.1, 2) for t in rng.sample("abcdefghijkl", rng.randint(1, 3))}
        rows.append((i, sum(w * w for w in weights.values()) ** 0.5, weights, lo, lo + rng.choice([0.0, rng.uniform(0, 4)])))
    cells = spark.createDataFrame(rows, "id bigint, norm double, weights map<string,double>, lo double, hi double")
    got = {(r["a"], r["b"]): r["cos"] for r in similar.band_pairs(cells, 0.4, 3.0, 9.0, heavy_rows).collect()}
    want = {}
    for a, b in itertools.combinations(rows, 2):
        gap, span = max(0.0, b[3] - a[4], a[3] - b[4]), max(a[4] - b[3], b[4] - a[3])
        if gap <= 9 and span > 3 and 0 < cosine(a[2], b[2]) < 0.4:
            want[(a[0], b[0])] = cosine(a[2], b[2])
    assert got.keys() == want.keys() and got == pytest.approx(want)

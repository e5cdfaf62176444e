"""Rules that must hold at every size: boundaries, nulls, whole series, sizes of buckets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventlens.functions import text as X
from eventlens.operators import events, series, similar
from eventlens.operators import features as V
from eventlens.operators.similar import Candidates
from eventlens.session import cut, remove_steps, spread, work_dir
from eventlens.skew import group_pairs

from .test_similarity import make_tweets


def recursion(values, a=0.5):
    s = values[0]
    for x in values[1:]:
        s = a * x + (1 - a) * s
    return s


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("n", [1, 7, 500, 1500])
@pytest.mark.parametrize(
    "head", [[], [NAN], [INF], [-INF, 1.0], [INF, -INF], [1e300], [1e300, 0.0, 2.0], [-1e-300]]
)
def test_moving_average_is_the_recursion(spark, n, head):
    rnd = random.Random(n)
    tails = {"zeros": [0.0] * n, "noise": [rnd.gauss(0, 1) for _ in range(n)]}
    rows = [(k, i, v) for k, tail in tails.items() for i, v in enumerate(head + tail)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ts long, v double").repartition(4)
    got = {r["k"]: r["ema"] for r in series.moving_average(df, "k", ["ts"], "v").collect()}
    for k, tail in tails.items():
        want = recursion(head + tail)
        if math.isnan(want):
            assert math.isnan(got[k])
        else:
            assert got[k] == pytest.approx(want, rel=1e-9, abs=1e-320)


def test_moving_average_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 4.0), (2, 0, None), (None, 0, 7.0)], "k long, ts long, v double")
    got = {r["k"]: r["ema"] for r in series.moving_average(df, "k", ["ts"], "v").collect()}
    assert got == {1: 3.0, None: 7.0}
    assert series.moving_average(df.filter("false"), "k", ["ts"], "v").count() == 0


def test_normalised_texts_are_all_there(spark):
    rows = [(1, "abt u"), (1, "abt u"), (1, "u"), (2, None), (3, ""), (None, "u  abt U")]
    words = spark.createDataFrame([("abt", "about"), ("u", "you")], "token string, replacement string")
    got = X.normalize_words(spark.createDataFrame(rows, "id long, text string"), "id", "text", words).collect()
    want = [(1, "about you"), (1, "about you"), (1, "you"), (2, None), (3, ""), (None, "you  about U")]
    assert sorted(((r["id"], r["normalized"]) for r in got), key=repr) == sorted(want, key=repr)


def test_a_pair_at_the_threshold_counts(spark):
    # cos 0.3 at eps 0.35 has the distance 0.35
    rows = [(1, "x", 1.0), (2, "x", 0.3), (2, "y", math.sqrt(1 - 0.09))]
    profiles = V.profiles(spark.createDataFrame(rows, "id long, term string, w double"))
    near = Candidates(spark.createDataFrame([(1, 2, None)], "a long, b long, dot double"))
    found = similar.similar_pairs(profiles, near, 1.0 - 2.0 * 0.35).collect()
    assert [(r["a"], r["b"], r["cos"]) for r in found] == [(1, 2, 0.3)]


@pytest.mark.parametrize("eps", [0.35, 0.45, 0.5, 0.55])
def test_clusters_do_not_depend_on_bucket_size(spark, eps):
    df = spark.createDataFrame(make_tweets(24), "id bigint, words array<string>, created_at timestamp")
    labels = []
    for bucket_rows in (1, 3, 500):
        found = events.event_clusters(
            df, 3, eps, score_tokens=F.col("words"), rows=1, bands=2, time_decay="off", bucket_rows=bucket_rows
        )
        labels.append({r["id"]: (r["n"], r["core"], r["cluster"]) for r in found.points.collect()})
    assert labels[0] == labels[1] == labels[2]


def test_group_pairs_splits_any_large_group(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, g int")
    pairs = group_pairs(cut(rows), ["g"], "id", heavy_rows=4).select("id_a", "id_b").collect()
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2}
    assert len(pairs) == len(want) and {tuple(p) for p in pairs} == want


def test_spread_moves_only_few_partitions(spark):
    assert spread(spark.range(100, numPartitions=64)).rdd.getNumPartitions() == 64
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_steps_can_be_removed(spark, tmp_path):
    import os

    kept = cut(spark.range(5), "gone")
    path = kept.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path) and path.startswith(work_dir(spark).removeprefix("file://").removeprefix("file:"))
    remove_steps(spark)
    assert not os.path.exists(path)
    assert cut(spark.range(5), "again").count() == 5

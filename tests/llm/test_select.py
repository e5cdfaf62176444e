"""Toxicity, mixing and importance resampling."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import importance, mixing, toxicity
from eventlens.llm.words import chunks, word_hashes

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    bad = ["glimbrous", "wortzelpf", "skandrik", "moffugol"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = prose(rng, 8).split()
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxicity_on_unseen_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    # labels of fold 1 are not read
    other = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, other).weights == model.weights
    rows = docs.join(labels, "doc_id").filter(toxicity.fold("doc_id") == 1).select("toxic", toxicity.score("text", model).alias("s")).toPandas()
    assert ((rows["s"] >= 0.7) == (rows["toxic"] == 1)).mean() > 0.95


def test_toxicity_odd_rows(spark, labelled, odd_docs, no_docs):
    model = toxicity.train(*labelled)
    scored = odd_docs.select("n", "text", toxicity.score("text", model).alias("s")).collect()
    assert all(0 <= r["s"] < 0.7 for r in scored)
    by_text = defaultdict(set)
    for r in scored:
        by_text[r["text"] or ""].add(r["s"])
    assert all(len(s) == 1 for s in by_text.values())
    assert no_docs.select(toxicity.score("text", model)).count() == 0
    nothing = toxicity.train(no_docs, labelled[1].limit(0))
    assert {r[0] for r in odd_docs.select(toxicity.score("text", nothing)).collect()} == {0.0}
    doubtful = labelled[1].unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, None, 0)], labelled[1].schema))
    assert toxicity.train(labelled[0], doubtful).toxic


def weights_of(tokens, a):
    power = {s: (n / sum(tokens.values())) ** a for s, n in tokens.items()}
    return {s: p / sum(power.values()) for s, p in power.items()}


@pytest.fixture(scope="module")
def sourced(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else f"s{i % 11}" if i % 2 else None, rng.randint(1, 60)) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, mix_tokens long").repartition(5)


@pytest.mark.parametrize("limits", [{"target_entropy": 0.9}, {"max_repeats": 2.0}, {"max_repeats": 1.5, "full_pass": True}])
def test_mixture_meets_its_limit(sourced, limits):
    tokens = {r["source"]: r["t"] for r in sourced.groupBy("source").agg(F.sum("mix_tokens").alias("t")).collect()}
    mixed = mixing.mixture(sourced, **limits)
    want = weights_of(tokens, mixed.exponent)
    rows = {r["source"]: r for r in mixed.weights.collect()}
    assert all(abs(rows[s]["weight"] - w) < 1e-9 for s, w in want.items())
    entropy = -sum(w * math.log(w) for w in want.values())
    repeats = max(r["repeats"] for r in rows.values())
    assert entropy <= limits.get("target_entropy", 1) * math.log(len(tokens)) + 1e-6
    assert repeats <= limits.get("max_repeats", 4.0) + 1e-6
    flatter = weights_of(tokens, mixed.exponent - 1e-4)
    if "target_entropy" in limits:
        assert -sum(w * math.log(w) for w in flatter.values()) > limits["target_entropy"] * math.log(len(tokens))
    else:
        assert abs(repeats - limits["max_repeats"]) < 1e-3
    if limits.get("full_pass"):
        assert min(r["repeats"] for r in rows.values()) > 1 - 1e-6


@pytest.mark.parametrize("bucket_rows", [4096, 50])
def test_schedule_spends_each_budget(sourced, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    mixed = mixing.mixture(sourced, target_entropy=0.9, epochs=1.3)
    rows = mixing.schedule(sourced, mixed, block_tokens=2000).collect()
    facts = {r["source"]: r for r in mixed.weights.collect()}
    docs = Counter(r["source"] for r in sourced.collect())
    for source, fact in facts.items():
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: r["mix_before"])
        at = 0
        for r in own:  # the places are gapless and the last document reaches the budget
            assert r["mix_before"] == at < fact["budget"]
            assert r["mix_block"] == math.floor(at / (fact["weight"] * 2000.0))
            at += r["mix_tokens"]
        assert at >= fact["budget"] - 1e-6
        for k in range(int(fact["repeats"])):  # whole passes hold every document once
            assert len({r["doc_id"] for r in own if r["mix_pass"] == k}) == docs[source]
        passes = [[r["doc_id"] for r in own if r["mix_pass"] == k] for k in (0, 1)]
        assert len(own) < 20 or not passes[1] or passes[0][: len(passes[1])] != passes[1]


def test_mixing_odd_rows(odd_docs, no_docs):
    counted = odd_docs.withColumn("mix_tokens", mixing.token_count("text")).withColumn("mix_mark", F.xxhash64("text"))
    assert [r[0] for r in counted.filter("n in (5, 7, 8, 9)").orderBy("n").select("mix_tokens").collect()] == [1, 1, 1, 3]
    mixed = mixing.mixture(counted, full_pass=True, max_repeats=1.5)
    planned = mixing.schedule(counted, mixed, id_cols=("doc_id", "mix_mark"))
    out = mixing.permuted(planned, odd_docs.columns)
    assert out.columns == odd_docs.columns
    assert {r["n"] for r in out.collect()} == {r["n"] for r in odd_docs.collect()}
    empty = no_docs.withColumn("mix_tokens", mixing.token_count("text"))
    assert mixing.schedule(empty, mixing.mixture(empty)).count() == 0


def test_importance_weights(spark, some_docs, odd_docs, no_docs):
    docs = spark.createDataFrame(some_docs, "doc_id long, text string").repartition(4)
    target = docs.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id"))
    drawn = importance.resample(docs, target, 1.0, buckets=512).collect()
    bag = {i: importance.grams(*word_hashes(next(iter(chunks([t])))), 512)[0] for i, t in some_docs}
    every = sum(np.bincount(b, minlength=512) for b in bag.values()) + 1.0
    wanted = sum(np.bincount(b, minlength=512) for i, b in bag.items() if i % 4 == 0) + 1.0
    ratio = np.log(wanted / wanted.sum()) - np.log(every / every.sum())
    assert all(abs(r["log_weight"] - ratio[bag[r["id"]]].sum()) < 1e-6 for r in drawn)
    words = word_hashes([b"a b c a"])
    assert len(importance.grams(*words)[0]) == 7
    half = importance.resample(docs, target, 0.5, buckets=512).collect()
    best = sorted(drawn, key=lambda r: -r["key"])[: round(0.5 * len(some_docs))]
    assert {r["id"] for r in half} == {r["id"] for r in best}
    odd = importance.resample(odd_docs, target, 0.5)
    assert odd.count() == round(0.5 * odd_docs.count())
    assert importance.resample(no_docs, target, 0.5).count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 400, 700, 1999, 2000, 5000])
def test_largest(spark, monkeypatch, k):
    monkeypatch.setattr(importance, "SORT_ROWS", 20)
    rng = random.Random(k)
    values = [rng.choice([1.5, 1.5, rng.gauss(0, 1), rng.gauss(0, 100)]) for _ in range(2000)]
    rows = spark.createDataFrame([(v, int(v)) for v in values], "key double, x long")
    got = sorted(r["key"] for r in importance.largest(rows, "key", k).collect())
    assert got == sorted(values)[max(0, 2000 - k) :]


def test_gumbel_numbers(spark):
    values = np.array([r[0] for r in spark.range(20_000).select(importance.gumbel(3, "id")).collect()])
    assert abs(values.mean() - 0.5772) < 0.04
    assert abs(values.var() - math.pi**2 / 6) < 0.08


def test_entropy_of_nearly_equal_sources(spark):
    """A mixture less flat than the natural one needs an exponent above 1."""
    rows = [(i, f"s{i % 20}", 100 + i % 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_tokens long")
    mixed = mixing.mixture(docs, target_entropy=0.95)
    weights = [r["weight"] for r in mixed.weights.collect()]
    entropy = -sum(w * math.log(w) for w in weights if w)
    assert mixed.met and mixed.exponent > 1 and abs(sum(weights) - 1) < 1e-9
    assert abs(entropy / math.log(20) - 0.95) < 1e-4
    assert mixing.schedule(docs, mixed).count() > 0
    with pytest.warns(UserWarning, match="no exponent"):  # 1.5 repeats leave it flatter than asked
        near = mixing.mixture(docs, target_entropy=0.9, max_repeats=1.5)
    assert not near.met and 1.4 < max(r["repeats"] for r in near.weights.collect()) <= 1.5 + 1e-6
    with pytest.warns(UserWarning, match="no exponent"):
        equal = mixing.mixture(docs.withColumn("mix_tokens", F.lit(7)), target_entropy=0.95)
    assert not equal.met and equal.exponent == 1

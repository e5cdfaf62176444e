import collections
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from eventlens.functions import similarity as S
from eventlens.operators import events, lsh, similar
from eventlens.operators import features as V
from eventlens.session import cut, new_path
from eventlens.sources import store

from .brute import clusters, cosine, tfidf


def make_tokens(n=60, seed=5):
    """Texts over a few common and many rare words; a third are copies or near copies of one."""
    rnd = random.Random(seed)
    words = ["com", "mon", "dom"] + [f"w{i}" for i in range(40)]
    out = {}
    for i in range(n):
        if i % 3 == 0:
            out[i] = ["story", "of", "day"] + (["extra", f"w{rnd.randrange(40)}"] if i % 2 else [])
        else:
            out[i] = [rnd.choice(words[: 3 if rnd.random() < 0.5 else 43]) for _ in range(rnd.randrange(2, 9))]
    return out


@pytest.fixture(scope="module")
def profiles(spark):
    rows = spark.createDataFrame(list(make_tokens().items()), "id bigint, tokens array<string>")
    return cut(V.profiles(V.tfidf(V.term_freq(rows))))


def wanted_pairs(threshold, allowed=lambda a, b: True):
    vectors = tfidf(make_tokens())
    return {
        (a, b): cosine(vectors[a], vectors[b])
        for a, b in itertools.combinations(sorted(vectors), 2)
        if allowed(a, b) and cosine(vectors[a], vectors[b]) >= threshold
    }


def found_pairs(df):
    return {(r["a"], r["b"]): r["cos"] for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_similarity_join(profiles, threshold):
    blocks = cut(profiles.select("id", F.lit(0).cast("bigint").alias("block")))
    near = similar.term_candidates(profiles, threshold, blocks)
    assert found_pairs(similar.similar_pairs(profiles, near, threshold)) == pytest.approx(wanted_pairs(threshold))


def test_similarity_join_by_blocks(profiles):
    blocks = cut(profiles.select("id", F.floor(F.col("id") / 10).alias("block")))
    near = similar.term_candidates(profiles, 0.3, blocks)
    got = found_pairs(similar.similar_pairs(profiles, near, 0.3))
    want = wanted_pairs(0.3, lambda a, b: abs(a // 10 - b // 10) <= 1)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("bucket_rows", [500, 2])
def test_candidates_from_buckets(profiles, bucket_rows):
    blocks = cut(profiles.select("id", F.lit(0).cast("bigint").alias("block")))
    sigs = cut(lsh.profile_signatures(profiles, 4, 4))
    by_id = {r["id"]: r["sigs"] for r in sigs.collect()}

    def meet(a, b):
        return a in by_id and b in by_id and any(x == y for x, y in zip(by_id[a], by_id[b]))

    near = similar.bucket_candidates(profiles, 0.3, blocks, lsh.hash_tables(sigs), bucket_rows)
    got = found_pairs(similar.similar_pairs(profiles, near, 0.3, sigs))
    assert got == pytest.approx(wanted_pairs(0.3, meet))


def test_candidate_counts(profiles):
    sigs = cut(lsh.profile_signatures(profiles, 3, 4))
    by_id = {r["id"]: r["sigs"] for r in sigs.collect()}
    shared = {
        i: [sum(x == y for x, y in zip(s, t)) for j, t in by_id.items() if j != i] for i, s in by_id.items()
    }
    for heavy_rows in (1_000_000, 3):
        got = {r["id"]: (r["n_raw"], r["n_distinct"]) for r in lsh.candidate_counts(sigs, 4, heavy_rows).collect()}
        assert got == {i: (sum(n), sum(x > 0 for x in n)) for i, n in shared.items()}
    row = lsh.pair_counts(sigs, 4).first()
    assert (row["raw_pairs"], row["distinct_pairs"]) == (
        sum(map(sum, shared.values())) // 2, sum(x > 0 for n in shared.values() for x in n) // 2)
    more, four = [s + s[:3] for s in by_id.values()], list(by_id.items())
    wide = sigs.select("id", F.concat("sigs", F.slice("sigs", 1, 3)).alias("sigs"))
    want = {
        i: (sum(sum(x == y for x, y in zip(s, t)) for k, t in enumerate(more) if four[k][0] != i),
            sum(any(x == y for x, y in zip(s, t)) for k, t in enumerate(more) if four[k][0] != i))
        for (i, _), s in zip(four, more)
    }
    got = {r["id"]: (r["n_raw"], r["n_distinct"]) for r in lsh.candidate_counts(wide, 7, 3).collect()}
    assert got == want
    row = lsh.pair_counts(wide, 7).first()
    assert (2 * row["raw_pairs"], 2 * row["distinct_pairs"]) == tuple(map(sum, zip(*want.values())))
    tables = cut(lsh.hash_tables(sigs))
    query = next(iter(by_id))
    got = lsh.candidates(tables, tables.filter(F.col("id") == query), heavy_rows=2).collect()
    assert sum(r["shared"] for r in got) == sum(shared[query])
    sizes = collections.Counter((t, s) for sig in by_id.values() for t, s in enumerate(sig))
    assert {(r["table_id"], r["sig"]): r["n"] for r in lsh.bucket_index(tables).collect()} == sizes


def test_signatures_do_not_depend_on_partitions_or_blocks(spark):
    rows = [(i, f"t{j}", ((i * 7 + j) % 5) - 1.5) for i in range(9) for j in range(12)]
    df = spark.createDataFrame(rows, "id bigint, term string, w double")
    wide = {r["id"]: r["bits"] for r in lsh.hash_bits(df, 50, 6).collect()}
    narrow = {r["id"]: r["bits"] for r in lsh.hash_bits(df.repartition(1), 5, 4).collect()}
    assert all(len(b) == 300 and b.startswith(narrow[i]) for i, b in wide.items())
    flat = spark.createDataFrame([(1, "a", 0.0)], "id bigint, term string, w double")
    assert lsh.hash_bits(flat).first()["bits"] == "0" * 16


def test_model_store(spark, profiles):
    sigs = lsh.profile_signatures(profiles, 4, 4)
    model = store.LshModel(lsh.hash_tables(sigs), 4, 4, 42)
    path = new_path(spark, "model")
    store.save_model(model, path)
    loaded = store.load_model(spark, path)
    assert (loaded.rows, loaded.bands, loaded.seed) == (4, 4, 42)
    assert loaded.tables.exceptAll(model.tables).count() == 0
    for bad in (model.tables.limit(0), model.tables.withColumn("sig", F.lit("01"))):
        path = new_path(spark, "model")
        store.save_model(store.LshModel(bad, 4, 4, 42), path)
        with pytest.raises(ValueError):
            store.load_model(spark, path)
    ids = spark.createDataFrame([(0,)], "id bigint")
    assert lsh.remove(loaded.tables, ids).filter("id = 0").count() == 0


RESOURCE = "array<struct<uri string, in_links array<string>>>"


def test_set_similarity(spark):
    a, b, c, d = (("a", ["x", "y"]), ("b", ["y", "z"]), ("c", ["q"]), ("d", ["x", "y"]))
    cases = [([a], [b, d]), ([a, c], [b, d]), ([a, b, c], [d]), ([], [a]), ([], [])]
    df = spark.createDataFrame(cases, f"l {RESOURCE}, r {RESOURCE}")
    left, right = F.col("l"), F.col("r")
    rows = df.select(
        S.set_similarity(left, right, S.shared_links).alias("mean"),
        S.set_similarity_max(left, right, S.shared_links).alias("top"),
        S.semantic_similarity(left, right, S.shared_links).alias("sem"),
        S.semantic_similarity(left, right).alias("any"),
    ).collect()
    third = 1 / 3
    assert [r["mean"] for r in rows[:3]] == pytest.approx([1.0, (0.5 + (third + 1) / 2) / 2, 1.0])
    assert rows[3]["mean"] is None and rows[4]["mean"] is None
    assert [r["top"] for r in rows] == pytest.approx([1, 1, 1, 0, 0])
    assert [r["sem"] for r in rows[3:]] == [1.0, 1.0] and all(r["any"] == 1.0 for r in rows)


START = dt.datetime(2024, 3, 1)


def make_tweets(n=70, seed=11):
    """Half of all tweets are copies of one text, spread over five days."""
    rnd = random.Random(seed)
    tokens = make_tokens(n, seed)
    rows = []
    for i, words in tokens.items():
        words = ["same", "old", "story"] if i % 2 else words
        rows.append((i, words, START + dt.timedelta(minutes=rnd.randrange(0, 120 * 60))))
    return rows


@pytest.mark.parametrize("limits", [{}, {"leaf_pairs": 3, "heavy_rows": 6, "bucket_rows": 2}])
@pytest.mark.parametrize(
    "options",
    [
        {"candidates": "exact", "time_decay": "hours"},
        {"candidates": "exact", "time_decay": "off", "border": "min"},
        {"candidates": "lsh", "rows": 3, "bands": 4, "count_mode": "bands"},
    ],
)
def test_events_equal_brute_force(spark, options, limits):
    rows = make_tweets()
    df = spark.createDataFrame(rows, "id bigint, words array<string>, created_at timestamp")
    eps, min_pts = 0.35, 5
    got = events.event_clusters(df, min_pts, eps, score_tokens=F.col("words"), **options, **limits)
    vectors = {i: v for i, v in tfidf({r[0]: r[1] for r in rows if len(r[1]) >= 2}).items() if v}
    times = {r[0]: r[2] for r in rows}
    decay, bands = options["time_decay"] != "off" if "time_decay" in options else True, options.get("bands", 0)
    sigs = {}
    if bands:
        long = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "id bigint, term string, w double")
        sigs = {r["id"]: r["sigs"] for r in lsh.signatures(long, 3, 4).collect()}
    pairs = {}
    for a, b in itertools.combinations(sorted(vectors), 2):
        apart = abs((times[a] - times[b]).total_seconds()) / 3600
        time = 1 - min(apart / 72, 1) if decay else 1.0
        cos = cosine(vectors[a], vectors[b])
        shared = sum(x == y for x, y in zip(sigs[a], sigs[b])) if bands else 1
        if shared and cos >= 1 - 2 * eps and round(1 - time * (cos + 1) / 2, 9) <= eps:
            pairs[(a, b)] = shared
    want = clusters(list(vectors), list(pairs), lambda n: n > min_pts, options.get("border", "bridge"), pairs, bands or 1)
    assert {r["id"]: (r["n"], r["core"], r["cluster"]) for r in got.points.collect()} == want


def test_exact_candidates_beyond_one_half_need_equal_entities(spark):
    with pytest.raises(ValueError):
        events.event_clusters(spark.range(1), eps=0.5, candidates="exact", resources=spark.range(1))


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_block_pairs(spark, block_rows, monkeypatch):
    """All pairs of a few blocks or one, with dense and listed products."""
    from eventlens.operators import blockpairs

    monkeypatch.setattr(blockpairs, "DENSE_TERMS", 4)
    monkeypatch.setattr(blockpairs, "LISTED_PAIRS", 50)
    rng = random.Random(block_rows)
    vectors = {}
    for i in range(60):
        terms = rng.sample("abcdef", rng.randint(0, 4)) + rng.sample([f"t{k}" for k in range(40)], rng.randint(1, 8))
        vectors[i * 7] = {t: rng.uniform(0.1, 3) for t in terms}
    vectors[1] = dict(vectors[0])
    long = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "id bigint, term string, w double")
    got = {(r["a"], r["b"]): r["cos"] for r in blockpairs.cosine_pairs(V.profiles(long), 0.3, block_rows).collect()}
    want = {(a, b): cosine(vectors[a], vectors[b]) for a, b in itertools.combinations(sorted(vectors), 2)}
    want = {k: c for k, c in want.items() if c >= 0.3}
    assert got.keys() == want.keys() and got == pytest.approx(want)
    none = V.profiles(long.filter("false"))
    assert blockpairs.cosine_pairs(none, 0.3).count() == 0
    with pytest.raises(ValueError):
        blockpairs.cosine_pairs(none, 0.0)


def test_block_pairs_settle_stretches_and_signatures_in_tiles(spark, monkeypatch):
    """What a pair must have besides its cosine is settled in the tile, so only results leave a group."""
    from eventlens.operators import blockpairs

    monkeypatch.setattr(blockpairs, "TILE_ROWS", 7)
    rng = random.Random(4)
    vectors = {i: {t: rng.uniform(0.1, 3) for t in rng.sample("abcdefgh", 3)} for i in range(40)}
    long = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "id bigint, term string, w double")
    block = {i: rng.choice([-1, 0, 1, 2, 5]) for i in vectors}
    sigs = {i: ["".join(rng.choice("01") for _ in range(2)) for _ in range(3)] for i in vectors if i != 13}
    stretches = spark.createDataFrame(list(block.items()), "id bigint, block bigint")
    signed = spark.createDataFrame(list(sigs.items()), "id bigint, sigs array<string>")
    found = blockpairs.cosine_pairs(V.profiles(long), 0.3, 20, stretches, signed).collect()
    got = {(r["a"], r["b"]): (r["cos"], r["shared"]) for r in found}
    want = {}
    for a, b in itertools.combinations(sorted(sigs), 2):
        shared = sum(x == y for x, y in zip(sigs[a], sigs[b], strict=True))
        cos = cosine(vectors[a], vectors[b])
        if cos >= 0.3 and shared and abs(block[a] - block[b]) <= 1:
            want[(a, b)] = (cos, shared)
    assert len(found) == len(got) and got.keys() == want.keys() and want
    assert all(got[k][1] == n and got[k][0] == pytest.approx(c) for k, (c, n) in want.items())


@pytest.mark.parametrize("block_rows", [7, 8000])
def test_a_vector_goes_once_to_a_pair_of_places(profiles, monkeypatch, block_rows):
    blocks = cut(profiles.select("id", F.floor(F.col("id") / 10).alias("block")))
    near = similar.term_candidates(profiles, 0.3, blocks)
    got = similar.similar_pairs(profiles, near, 0.3, None, blocks, block_rows)
    assert found_pairs(got) == pytest.approx(wanted_pairs(0.3, lambda a, b: abs(a // 10 - b // 10) <= 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "map_zip_with" not in plan
    none = similar.Candidates(near.pairs.filter("false"))
    assert similar.similar_pairs(profiles, none, 0.3, None, blocks).count() == 0

"""Running averages and posting lists: long series and crowded buckets in bounded pieces."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from eventlens.operators import lsh, series

SCHEMA = "k string, ts long, v double, ema string"


def running(values, a=0.5):
    out, s = [], None
    for x in values:
        if x is not None:
            s = x if s is None else a * x + (1 - a) * s
        out.append(s)
    return out


@pytest.mark.parametrize(("stretch", "n", "a"), [(128, 1500, 0.5), (3, 200, 0.1), (2, 40, 1.0)])
def test_running_average_is_the_recursion(spark, monkeypatch, stretch, n, a):
    monkeypatch.setattr(series, "STRETCH", stretch)
    rnd = random.Random(n)
    by_key = {
        "noise": [rnd.gauss(0, 1) for _ in range(n)],
        "gaps": [None, None, 5.0] + [rnd.choice([None, 1.0, -2.5]) for _ in range(n // 2)],
        None: [7.0, 3.0],
        "nothing": [None, None],
        "large": [1e300, 1e300, 0.0, float("inf"), 1.0],
    }
    rows = [(k, i, v, f"kept{i}") for k, values in by_key.items() for i, v in enumerate(values)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("ema", "part").repartition(4)
    got = series.running_average(df, "k", ["ts"], "v", a)
    assert got.columns == ["k", "ts", "v", "part", "ema"]
    found = {(r["k"], r["ts"]): (r["v"], r["part"], r["ema"]) for r in got.collect()}
    assert len(found) == len(rows)
    for k, values in by_key.items():
        if k == "large" and a == 1.0:
            continue  # nothing times infinity
        for i, (v, want) in enumerate(zip(values, running(values, a), strict=True)):
            assert found[k, i][:2] == (v, f"kept{i}")
            assert found[k, i][2] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-300))


def test_running_average_of_nothing_and_of_a_column_of_its_name(spark):
    df = spark.createDataFrame([("a", 0, 2.0, "old"), ("a", 1, 4.0, "old")], SCHEMA)
    assert [r["ema"] for r in series.running_average(df, "k", ["ts"], "v").orderBy("ts").collect()] == [2.0, 3.0]
    assert series.running_average(df.filter("false"), "k", ["ts"], "v").count() == 0


def test_posting_lists_are_bounded_and_whole(spark):
    rows = [(0, "11", i * i) for i in range(500)] + [(1, format(i % 3, "02b"), -i) for i in range(90)]
    rows += [(0, "00", 7), (0, "00", 7), (2, "10", 2**62), (2, "10", -(2**61)), (2, "10", None)]
    tables = spark.createDataFrame(rows, "table_id int, sig string, id bigint").repartition(5)
    chunks = lsh.bucket_members(tables, chunk=10).cache()
    assert chunks.agg(F.max("n")).first()[0] == 10 and chunks.filter("n <> size(gaps) OR gaps[0] <> 0").count() == 0
    assert chunks.filter("table_id = 0 AND sig = '11'").count() >= 50
    got = collections.Counter(map(tuple, lsh.expand_members(chunks).collect()))
    assert got == collections.Counter(r for r in rows if r[2] is not None)
    assert lsh.bucket_members(tables.filter("false")).count() == 0


def test_signs_of_native_sums(spark):
    rows = [(i, f"t{j}", math.sin(i * 31 + j)) for i in range(6) for j in range(40)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "id bigint, term string, w double")
    signs = df.filter("term IS NOT NULL").select("term").distinct().withColumns({f"d{b}": lsh.sign_digest(F.col("term"), b) for b in (0, 1)})
    functions = [0, 59, 60, 119, 239, 240, 259]
    planes = {
        r["term"]: [r[f"s{i}"] for i in functions]
        for r in signs.select("term", *[lsh.sign_bit(F.col(f"d{i // 240}"), i).alias(f"s{i}") for i in functions]).collect()
    }
    got = {r["id"]: r["bits"] for r in lsh.hash_bits(df, 26, 10).collect()}
    assert got[9] == "0" * 260
    for i in range(6):
        dots = [sum(w * (1 if planes[t][k] else -1) for j, t, w in rows if j == i) for k in range(len(functions))]
        assert [got[i][f] for f in functions] == ["1" if d > 1e-9 else "0" for d in dots]


def test_pairs_of_groups_go_as_numbers_and_meet_once(spark):
    rnd = random.Random(3)
    for width in (2, 70):  # short signatures are numbers, long ones stay texts
        sigs = [["".join(rnd.choice("01") for _ in range(2)).rjust(width, "1") for _ in range(8)] for _ in range(40)]
        df = spark.createDataFrame(list(enumerate(sigs)), "id bigint, sigs array<string>")
        _, pairs = lsh._met_groups(df, 8)
        assert dict(pairs.dtypes) == {"id_a": "bigint", "n_a": "bigint", "id_b": "bigint", "n_b": "bigint"}
        got = collections.Counter((r["id_a"], r["id_b"]) for r in pairs.collect())
        first = {tuple(s): i for i, s in reversed(list(enumerate(sigs)))}
        want = {(i, j) for s, i in first.items() for t, j in first.items() if i < j and any(x == y for x, y in zip(s, t))}
        assert set(got) == want and set(got.values()) <= {1}


def test_signs_are_found_for_batches_of_documents(spark):
    plan = lsh.hash_bits(spark.createDataFrame([(1, "a", 1.0)], "id bigint, term string, w double"))
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
    odd = [(1, "a", float("nan")), (2, None, 1.0), (2, "a", None), (None, "a", 2.0), (3, "a", float("inf"))]
    got = {r["id"]: r["bits"] for r in lsh.hash_bits(spark.createDataFrame(odd, "id bigint, term string, w double")).collect()}
    sign = got[3]
    assert got[1] == "1" * 16 and got[2] == "0" * 16 and got[None] == sign and "0" in sign and "1" in sign

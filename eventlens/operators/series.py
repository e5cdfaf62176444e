"""Ordered series: moving averages and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, measured_cut

SMOOTHING = 0.5

#: Members of a stretch, at every level.
STRETCH = 512

#: What a stretch of a series does to the average ``s`` before it: with ``n`` values it becomes
#: ``(1 - a)^n s + added``, and ``begun`` where there is none before.
EFFECT = "struct<n:bigint,begun:double,added:double>"


def _ranges(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shrunk(s: Column, n: Column, decay: float) -> Column:
    # in three steps, so that no power is 0 before the product is
    third = F.floor(n / 3)
    steps = [F.pow(F.lit(decay), third), F.pow(F.lit(decay), third), F.pow(F.lit(decay), n - 2 * third)]
    many = F.when(F.abs(s) == F.lit(float("inf")), s).otherwise(s * steps[0] * steps[1] * steps[2])
    return F.when(n == 0, s).when(n == 1, s * decay).otherwise(many)


def _after(s: Column, effect: Column, decay: float) -> Column:
    """The average after a stretch; null before the first value."""
    return F.when(s.isNull(), effect["begun"]).otherwise(effect["added"] + _shrunk(s, effect["n"], decay))


def _joined(effects: Column, decay: float) -> Column:
    """The effect of consecutive stretches."""
    return F.aggregate(
        effects,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("begun"), F.lit(0.0).alias("added")),
        lambda s, e: F.struct(
            (s["n"] + e["n"]).alias("n"),
            _after(s["begun"], e, decay).alias("begun"),
            (e["added"] + _shrunk(s["added"], e["n"], decay)).alias("added"),
        ),
    )


def _averages(before: Column, effects: Column, decay: float) -> Column:
    """The average before each of some consecutive stretches."""
    seen = F.struct(before.alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(
        effects, seen,
        lambda t, e: F.struct(_after(t["s"], e, decay).alias("s"), F.concat(t["out"], F.array(t["s"])).alias("out")),
    )["out"]


def _stretches(rows: DataFrame, decay: float) -> list[DataFrame]:
    """Levels of stored stretches ``(key, part, place, items, effect)`` over the members ``(key, part,
    place, effect, ...)``, where ``place`` counts a series' members within a part: up to ``STRETCH`` members
    make a stretch, which is a member of the next level, until a series has one stretch a part."""
    levels, last = [], None
    while last is None or last > 0:
        item = F.struct("place", *[c for c in rows.columns if c not in ("key", "part", "place")])
        stretch = F.floor(F.col("place") / STRETCH).alias("stretch")
        # the caller's columns may have no order; without them the natural one, by place, is faster
        by = [_by_place] if "row" in rows.columns else []
        grouped = rows.groupBy("key", "part", stretch).agg(F.array_sort(F.collect_list(item), *by).alias("items"))
        level = grouped.select(
            "key", "part", F.col("stretch").alias("place"), "items",
            _joined(F.transform("items", lambda i: i["effect"]), decay).cast(EFFECT).alias("effect"),
        )
        level, facts = measured_cut(level, "stretches", last=F.max("place"))
        levels.append(level)
        last = facts["last"] or 0
        rows = level.drop("items")
    return levels


def _by_place(a: Column, b: Column) -> Column:
    return (a["place"] - b["place"]).cast("int")


def _members(df: DataFrame, key: str, order: list[str], value: str, smoothing: float, keep: list[str]) -> DataFrame:
    """Rows as members of the first level. They are sorted by ranges of series and order, so a long series
    is spread over parts, and no window holds more than the rows of a range."""
    x = F.col("x")
    rows = df.select(
        F.col(key).alias("key"), F.struct(*order).alias("at"), F.col(value).cast("double").alias("x"),
        F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"),
    )
    ranged = rows.repartitionByRange(_ranges(df), "key", "at").withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("key", "part").orderBy("at")
    effect = F.struct(
        F.when(x.isNull(), 0).otherwise(1).cast("bigint").alias("n"), x.alias("begun"),
        F.coalesce(smoothing * x, F.lit(0.0)).alias("added"),
    )
    return ranged.select("key", "part", (F.row_number().over(own) - 1).cast("bigint").alias("place"), effect.alias("effect"), "row")


def _parts(level: DataFrame) -> DataFrame:
    """``(key, parts)``: a series' parts in order, at most one a range."""
    part = F.struct("part", "effect")
    return level.groupBy("key").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def moving_average(
    df: DataFrame, key: str, order: list[str], value: str, smoothing: float = SMOOTHING
) -> DataFrame:
    """``(key, ema)``: ``s_1 = x_1``, ``s_t = a x_t + (1 - a) s_{t-1}``, at the end of each series.

    A long series is spread over tasks by ranges of its order, whose values should be unique in a series. The
    effects of stretches of rows are put together, stretch by stretch, then part by part. Null values are left
    out, and a series of them; NaN and infinity go through as in the recursion.
    """
    decay = 1.0 - smoothing
    members = _members(df.filter(F.col(value).isNotNull()), key, order, value, smoothing, []).drop("row")
    top = _stretches(members, decay)[-1]
    ema = _joined(F.transform("parts", lambda p: p["effect"]), decay)["begun"]
    return _parts(top).select(F.col("key").alias(key), ema.alias("ema"))


def running_average(
    df: DataFrame, key: str, order: list[str], value: str, smoothing: float = SMOOTHING, name: str = "ema"
) -> DataFrame:
    """All rows with the moving average up to each of them as ``name`` (a column of that name is replaced).

    A segmented scan: the effects of stretches are put together upwards, as in ``moving_average``; then the
    average before each part, stretch and row follows downwards. A null value keeps the average of the row
    before, null where there is none. Values of ``order`` should be unique in a series.
    """
    decay = 1.0 - smoothing
    keep = [c for c in df.columns if c != name]
    levels = _stretches(_members(df, key, order, value, smoothing, [F.col(f"`{c}`") for c in keep]), decay)
    parts = F.col("parts")
    before = _averages(F.lit(None).cast("double"), F.transform(parts, lambda p: p["effect"]), decay)
    known = _parts(levels[-1]).select("key", F.inline(F.arrays_zip(parts["part"].alias("part"), before.alias("before"))))
    known = known.withColumn("place", F.lit(0).cast("bigint"))
    for level in reversed(levels):
        told = known.select(*[F.col(c).alias(f"known_{c}") for c in ("key", "part", "place")], "before")
        same = [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in ("key", "part", "place")]
        told = level.join(told, same[0] & same[1] & same[2]).select("key", "part", "items", "before")
        each = _averages(F.col("before"), F.transform("items", lambda i: i["effect"]), decay)
        rows = told.select("key", "part", F.explode(F.arrays_zip(F.col("items").alias("item"), each.alias("before"))).alias("m"))
        known = rows.select("key", "part", F.col("m.item.place").alias("place"), F.col("m.before").alias("before"), "m")
    ema = _after(F.col("m.before"), F.col("m.item.effect"), decay)
    return known.select(*[F.col(f"m.item.row.`{c}`").alias(c) for c in keep], ema.alias(name))


def series_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"))


def number_rows(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Number all rows from 0 in the order of ``order``, whose values must be unique.

    Rows are sorted by range partitions and stored; a partition's first number is the size of the
    partitions before it. Only those sizes, one row per partition, meet in one window.
    """
    ranged = cut(
        df.repartitionByRange(_ranges(df), *order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    own = Window.partitionBy("_range").orderBy(*order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        ranged.withColumn("_row", F.row_number().over(own))
        .join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_start") + F.col("_row") - 1)
        .drop("_range", "_row", "_start")
    )

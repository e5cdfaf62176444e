"""Joins on keys of which one may hold a large part of all rows.

Both helpers count rows per key first. A key is *heavy* above ``limit`` rows, where ``limit``
is at least one ten-thousandth of all rows, so at most ``MAX_HEAVY_KEYS`` keys are heavy: that
bound is what makes the heavy-key table safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 1_000_000
MAX_HEAVY_KEYS = 10_000


def heavy_limit(total: int, heavy_rows: int) -> int:
    return max(heavy_rows, total // MAX_HEAVY_KEYS)


def heavy_keys(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and the number of parts each is split into."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts"))
    )


def small_side(keys: DataFrame, total: int, limit: int) -> DataFrame:
    """A table of the keys that have more than ``limit`` of ``total`` rows: marked for a broadcast
    while there can be few of them, else left to the join that Spark picks."""
    return F.broadcast(keys) if total // limit <= MAX_HEAVY_KEYS else keys


def part_of(*cols: str) -> Column:
    """The part a row of a heavy key belongs to; 0 for every other key."""
    return F.when(
        F.col("_parts").isNull(), F.lit(0)
    ).otherwise(F.pmod(F.xxhash64(*cols), F.col("_parts").cast("bigint")).cast("int"))


def all_parts() -> Column:
    """Every part number of a key."""
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))


def skew_join(
    rows: DataFrame,
    keyed: DataFrame,
    keys: list[str],
    how: str = "inner",
    heavy_rows: int = HEAVY_ROWS,
    total: int | None = None,
    sized_by: DataFrame | None = None,
    row_id: list[str] | None = None,
) -> DataFrame:
    """Join ``rows`` (any number per key) with ``keyed`` (few per key).

    ``rows`` should be a stored table: its size is read first, and below ``heavy_rows`` no key
    can be heavy, so the plain join is used. Above it, heavy keys are split into parts by a hash
    of the row (of ``row_id``, if given) and the matching ``keyed`` rows are repeated once per
    part. ``sized_by`` is a stored table with the same number of rows per key, for rows that are
    computed.
    """
    stored = rows if sized_by is None else sized_by
    total = stored.count() if total is None else total
    if total <= heavy_rows:
        return rows.join(keyed, keys, how)
    heavy = F.broadcast(heavy_keys(stored, keys, heavy_limit(total, heavy_rows)))
    left = rows.join(heavy, keys, "left").withColumn("_part", part_of(*(row_id or rows.columns)))
    right = keyed.join(heavy, keys, "left").withColumn("_part", all_parts())
    return left.drop("_parts").join(right.drop("_parts"), [*keys, "_part"], how).drop("_part")


def group_pairs(
    rows: DataFrame,
    keys: list[str],
    id_col: str,
    step: str | None = None,
    others: DataFrame | None = None,
    heavy_rows: int = 20_000,
) -> DataFrame:
    """Pairs of rows with equal ``keys``: columns ``keys``, then every other column with the
    suffixes ``_a`` and ``_b``. Each unordered pair once, as ``a < b`` within a group; with
    ``others``, rows of ``rows`` as ``a`` meet those of ``others`` as ``b``, except themselves.

    With ``step``, one of the keys and an integer, rows also meet those whose ``step`` is one
    higher (with ``others``: or one lower); such pairs have any order of ids.

    A group above ``heavy_rows`` is laid out as a square of parts, one join key per square, so
    its pairs spread over many tasks instead of one. The limit does not grow with the data, as a
    part's pairs are its square; so there may be many such groups, and their table is broadcast only
    while their number is bounded.
    """
    right = rows if others is None else others
    total = rows.count() if others is None else rows.count() + others.count()
    values = [c for c in rows.columns if c not in keys]

    def side(df: DataFrame, suffix: str, *extra: str) -> DataFrame:
        return df.select(*keys, *extra, *[F.col(c).alias(f"{c}_{suffix}") for c in values])

    left = rows.withColumn("_same", F.lit(True))
    if step:
        offsets = [0, 1] if others is None else [-1, 0, 1]
        left = (
            rows.withColumn("_step", F.explode(F.array(*[F.lit(o) for o in offsets])))
            .withColumn("_same", F.col("_step") == 0)
            .withColumn(step, F.col(step) + F.col("_step"))
            .drop("_step")
        )
    if others is None:
        wanted = ~F.col("_same") | (F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))
    else:
        wanted = F.col(f"{id_col}_a") != F.col(f"{id_col}_b")
    if total <= heavy_rows:
        return side(left, "a", "_same").join(side(right, "b"), keys).filter(wanted).drop("_same")
    sized = left.select(*keys) if others is None else left.select(*keys).unionByName(right.select(*keys))
    rows_sized = total if step is None else total * len(offsets)
    heavy = small_side(heavy_keys(sized, keys, heavy_rows), rows_sized, heavy_rows)
    left = left.join(heavy, keys, "left").withColumn("_i", part_of(id_col)).withColumn("_j", all_parts())
    right = right.join(heavy, keys, "left").withColumn("_j", part_of(id_col)).withColumn("_i", all_parts())
    return (
        side(left, "a", "_same", "_i", "_j")
        .join(side(right, "b", "_i", "_j"), [*keys, "_i", "_j"])
        .filter(wanted)
        .drop("_same", "_i", "_j")
    )

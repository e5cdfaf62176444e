"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, measured_cut
from ..skew import HEAVY_ROWS, skew_join


def _store(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """Store an edge table; its row count and two checksums tell whether a round changed it."""
    return measured_cut(
        edges,
        name,
        n=F.count(F.lit(1)),
        x=F.bit_xor(F.xxhash64("u", "v")),
        y=F.bit_xor(F.xxhash64("v", F.lit(1), "u")),
    )


def _large_star(edges: DataFrame, total: int, heavy_rows: int) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        skew_join(both, low, ["u"], heavy_rows=heavy_rows, total=2 * total)
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, total: int, heavy_rows: int) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them (``u > v`` throughout)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        skew_join(edges, low, ["u"], heavy_rows=heavy_rows, total=total)
        .filter(F.col("v") > F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(low.withColumnRenamed("m", "v")).distinct()


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """``(id, component)`` for every vertex of an edge, ``component`` = its smallest vertex id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each round is two
    aggregations (combined map-side) and two joins, and ends in a written table. A hub vertex is
    only ever aggregated or split, never collected.
    """
    given = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")), "edges")
    current, mark = _store(
        given.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "start",
    )
    while mark["n"]:
        spread = _large_star(current, mark["n"], heavy_rows)
        if mark["n"] > heavy_rows:
            spread = cut(spread, "large")
        before = mark
        current, mark = _store(_small_star(spread, before["n"], heavy_rows), "small")
        if before == mark:
            break
    vertices = given.select(F.col("u").alias("id")).union(given.select("v")).distinct()
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )

"""Readers for line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``(id, x, y)`` from lines ``id TAB x TAB y``; further fields are ignored."""
    schema = "id bigint, x double, y double"
    return spark.read.schema(schema).option("sep", "\t").option("enforceSchema", True).csv(path)


def read_id_text(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text)`` from lines ``id TAB text``; lines with fewer than two fields are dropped."""
    fields = F.split("value", "\t")
    lines = spark.read.text(path).select(F.explode(F.array(fields)).alias("fields"))
    return lines.filter(F.size("fields") > 1).select(
        F.element_at("fields", 1).cast("bigint").alias("id"), F.element_at("fields", 2).alias("text")
    )


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A word dictionary ``token TAB replacement`` and the lines that are not of that form.

    A token that occurs again takes its last replacement. Lines are ordered by file, block and
    place in the block, so the file is read in as many tasks as it has blocks.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("place"),
        ).alias("at"),
        F.split("value", "\t").alias("fields"),
    )
    good = lines.filter(F.size("fields") > 1)
    entries = good.groupBy(F.element_at("fields", 1).alias("token")).agg(
        F.max_by(F.element_at("fields", 2), "at").alias("replacement")
    )
    return entries, lines.filter(F.size("fields") < 2).select("value")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))

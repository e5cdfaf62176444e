"""Reading dated texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = (
    "_id bigint, cleaned_text string, created_at timestamp, "
    "entities struct<hashtags: array<struct<text: string, indices: array<int>>>>, "
    "splitted_hashtags string"
)


def read_raw(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Raw documents; the schema is given, so nothing is read to infer it."""
    return spark.read.schema(RAW_SCHEMA).format(file_format).load(path)


def project_tweets(raw: DataFrame) -> DataFrame:
    """``(id, text, created_at, hashtags, split_hashtags)``."""
    tags = F.transform(F.col("entities.hashtags"), lambda h: h["text"])
    return raw.select(
        F.col("_id").alias("id"),
        F.col("cleaned_text").alias("text"),
        "created_at",
        F.coalesce(tags, F.array().cast("array<string>")).alias("hashtags"),
        F.col("splitted_hashtags").alias("split_hashtags"),
    )


def having_field(df: DataFrame, field: str) -> DataFrame:
    return df.filter(F.col(field).isNotNull())


def _instant(value: dt.datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def in_interval(df: DataFrame, start, end, column: str = "created_at") -> DataFrame:
    """Rows from ``start`` up to, not including, ``end``; pushed down to the scan for literals."""
    return df.filter((F.col(column) >= _instant(start)) & (F.col(column) < _instant(end)))


def from_offset(df: DataFrame, start: dt.datetime, hours: int, column: str = "created_at") -> DataFrame:
    """Rows of the ``hours`` hours from ``start`` on."""
    return in_interval(df, start, start + dt.timedelta(hours=hours), column)


def earliest(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.agg(F.min(column).alias("min_date"))


def lookup(df: DataFrame, ids: DataFrame, tags: bool = True) -> DataFrame:
    """Rows with the given ids, missing ones dropped. Without ``tags`` a tweet comes back as the
    by-id constructor makes it: no hashtags."""
    rows = df.join(ids.select("id").distinct(), "id", "left_semi")
    if tags:
        return rows
    return rows.withColumns(
        {"hashtags": F.array().cast("array<string>"), "split_hashtags": F.lit(None).cast("string")}
    )


def sample(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` rows by ``order``."""
    return df.orderBy(order).limit(n)

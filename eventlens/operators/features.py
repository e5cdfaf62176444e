"""Text features in long form: one row ``(id, term, w)`` per non-zero weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread
from ..skew import HEAVY_ROWS, all_parts, part_of, small_side

MIN_TOKENS = 2
MIN_DOC_FREQ = 2
HASH_SIZE = 2**18


def token_rows(
    df: DataFrame, id_col: str, tokens: Column, min_tokens: int = MIN_TOKENS, keep: list[str] | None = None
) -> DataFrame:
    """``(id, <keep>, tokens)`` of the rows with at least ``min_tokens`` tokens. The tokens leave
    through a generator, so that the filter does not compute them a second time."""
    rows = spread(df).select(
        F.col(id_col).alias("id"), *(keep or []), F.explode(F.array(tokens)).alias("tokens")
    )
    return rows.filter(F.size("tokens") >= min_tokens)


def term_freq(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """``(id, term, tf)`` plus one row with a null term per document, which lets the number of
    documents be counted from the same shuffle. ``copies`` names a column that tells how many
    documents a row stands for; it is carried along."""
    keep = [copies] if copies else []
    rows = rows.select("id", *keep, "tokens")
    terms = F.explode(F.array_append("tokens", F.lit(None).cast("string")))
    return (
        rows.select("id", *keep, terms.alias("term"))
        .groupBy("id", "term", *keep)
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def hashed_term_freq(rows: DataFrame, size: int = HASH_SIZE) -> DataFrame:
    """``(id, bucket, tf)`` with terms hashed to ``size`` buckets, by the first digits of a digest
    that other engines have too."""
    digits = F.substring(F.sha2("term", 256), 1, 13)
    bucket = F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(size)).alias("bucket")
    return (
        rows.select("id", F.explode("tokens").alias("term"))
        .groupBy("id", bucket)
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def doc_freq(tf: DataFrame, copies: str | None = None) -> DataFrame:
    """``(term, df)``; the row with a null term holds the number of documents."""
    one = F.col(copies) if copies else F.lit(1)
    return tf.groupBy("term").agg(F.sum(one.cast("bigint")).alias("df"))


def inverse_doc_freq(df: DataFrame, min_doc_freq: int = MIN_DOC_FREQ) -> DataFrame:
    """``(term, df, idf)``, ``idf = ln((m + 1) / (df + 1))`` and 0 below ``min_doc_freq``."""
    docs = df.filter("term IS NULL").agg(F.max("df")).scalar()
    idf = F.log((docs + 1) / (F.col("df") + 1))
    return df.filter("term IS NOT NULL").select(
        "term", "df", F.when(F.col("df") >= min_doc_freq, idf).otherwise(F.lit(0.0)).alias("idf")
    )


def tfidf(
    tf: DataFrame,
    min_doc_freq: int = MIN_DOC_FREQ,
    copies: str | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """``(id, term, df, w)`` without zero weights; ``tf`` should be a stored table.

    Term frequencies are shuffled by term once more here, and a common term sits in a large part
    of all documents. Its document frequency is known, so terms above ``heavy_rows`` rows are split
    over several tasks; at most rows / ``heavy_rows`` terms are, and they are broadcast while few.
    """
    idf = inverse_doc_freq(doc_freq(tf, copies), min_doc_freq).filter("idf <> 0")
    parts = F.ceil(F.col("df") / heavy_rows).cast("int")
    heavy = idf.filter(F.col("df") > heavy_rows).select("term", parts.alias("_parts"))
    left = tf.filter("term IS NOT NULL").join(small_side(heavy, tf.count(), heavy_rows), "term", "left")
    left = left.withColumn("_part", part_of("id")).drop("_parts")
    right = idf.withColumn("_parts", parts).withColumn("_part", all_parts()).drop("_parts")
    return left.join(right, ["term", "_part"]).select(
        "id", "term", "df", (F.col("tf") * F.col("idf")).alias("w")
    )


def text_vectors(df: DataFrame, id_col: str, tokens: Column, **options) -> DataFrame:
    """TF-IDF vectors of a table of texts. Texts are tokenised once: their term frequencies are
    stored, and read for the document frequencies and for the weights."""
    return tfidf(cut(term_freq(token_rows(df, id_col, tokens)), "tf"), **options)


def l2_norm(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length 1. The window holds the terms of one document."""
    own = Window.partitionBy("id")
    return vectors.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)))


def profiles(vectors: DataFrame) -> DataFrame:
    """``(id, norm, entries)``: one row per vector, entries ``(order, term, w)`` from the most
    common term to the rarest. What follows from a single vector needs no further shuffle."""
    order = -F.col("df") if "df" in vectors.columns else F.lit(0).cast("bigint")
    return vectors.groupBy("id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        F.array_sort(F.collect_list(F.struct(order.alias("order"), "term", "w"))).alias("entries"),
    )


def weights(entries: Column) -> Column:
    """Entries as a map from term to weight."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["term"], e["w"])))


def pack(vectors: DataFrame) -> DataFrame:
    """``(id, weights)`` with one map from term to weight per document."""
    return profiles(vectors).select("id", weights(F.col("entries")).alias("weights"))


def packed_dot(a: Column, b: Column) -> Column:
    """Dot product of two packed vectors."""
    shared = F.map_zip_with(a, b, lambda term, x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(F.map_values(shared), F.lit(0.0), lambda total, x: total + x)


def packed_cosine(a: Column, b: Column) -> Column:
    """Cosine of two packed vectors: 0 if either is empty, at most 1."""
    def squares(v: Column) -> Column:
        return F.aggregate(F.map_values(v), F.lit(0.0), lambda total, x: total + x * x)

    length = F.sqrt(squares(a)) * F.sqrt(squares(b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0) & (length > 0), F.least(F.lit(1.0), packed_dot(a, b) / length)
    ).otherwise(F.lit(0.0))


def average_vectors(vectors: DataFrame, group: str) -> DataFrame:
    """``(group, term, w)``: the mean of the weights a term has in the vectors of a group; a term
    in one of them only keeps its weight."""
    return vectors.groupBy(group, "term").agg(F.avg("w").alias("w"))


def top_terms(vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest terms per document, ties by term; the window holds one document."""
    order = Window.partitionBy("id").orderBy(F.desc(F.round("w", 9)), "term")
    return vectors.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def word_count(rows: DataFrame) -> DataFrame:
    """``(term, n)`` over all documents; counts are combined before the shuffle."""
    return (
        rows.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    )

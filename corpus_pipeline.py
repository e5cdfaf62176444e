"""From documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each result as Parquet to the shared folder and reads it
back for the next stage, so a lost executor never costs more than the current stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import jaccard, mixing, packing, queries, spans, toxicity
from eventlens.session import cut

#: How often the mixture may repeat a document; every source is gone through at least once.
MOST_REPEATS = 1.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit; null and empty texts are scored too."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score("text", model) < queries.REJECT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of equal rows one. Documents
    without words are in no group."""
    queries.small_batches(spark)
    name = F.struct("doc_id", F.xxhash64("text").alias("mark"))
    rows = jaccard.near_duplicates(docs.select(name.alias("name"), "text"), id_col="name")
    first = rows.filter(F.col("id").eqNullSafe(F.col("component"))).select("id.doc_id", "id.mark").distinct()
    own, mark = spans.fresh(docs.columns, "_first_id"), spans.fresh(docs.columns, "_first_mark")
    first = first.select(F.col("doc_id").alias(own), F.col("mark").alias(mark))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark))
    return docs.join(first, same, "left_semi").dropDuplicates(["doc_id", "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of passages that occur before; a document that has nothing
    else goes. ``n_chars`` follows a text that changes."""
    removed = spans.fresh(docs.columns, "_removed")
    left = spans.remove_repeats(docs, removed=removed)
    changed = F.size(removed) > 0
    sized = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.filter(~(changed & (F.length(F.trim("text")) == 0))).withColumn("n_chars", sized).drop(removed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in permuted blocks that hold the sources at their weights. Small sources are
    repeated, none is cut; null is a source like any other, a null or empty text has the tokens that
    ``token_count`` gives it, equal rows are interchangeable."""
    # all columns travel in one, so that their names cannot clash with the plan's
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
        mixing.token_count("text").alias("mix_tokens"), F.xxhash64("text").alias("mark"),
    )
    mixed = mixing.mixture(counted, max_repeats=MOST_REPEATS, full_pass=True)
    planned = mixing.schedule(counted, mixed, id_cols=("doc_id", "mark"))
    return mixing.permuted(planned, ["row"]).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids."""
    queries.small_batches(spark)
    return packing.pack(docs, queries.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no zstandard dictionaries, vocabularies or equal hashes; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

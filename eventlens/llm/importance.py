"""Importance resampling: texts drawn by how much likelier a target model finds them.

Two models are fitted, one on target text, one on all text: each a distribution over hashed words
and pairs of words. A text's log weight is the sum over its words and pairs of the log ratio. To
each weight a Gumbel number is added, and the largest ``k`` sums are the sample: drawn without
replacement, in proportion to the weights. The ``k``-th largest is found by narrowing a histogram.

Edge cases: null and empty texts have log weight 0; without target texts every weight is 0 and the
sample is uniform; equal rows have equal sums, and of those at the limit any may be taken, as they
are the same; rows with equal ids are told apart by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .words import chunks, mix, word_hashes

BUCKETS = 1 << 16
SEED = 5
#: Rows among which the last place of the sample is found by sorting.
SORT_ROWS, BINS = 10_000, 1024


def grams(words: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, and the text each belongs to."""
    text = np.repeat(np.arange(len(counts)), counts)
    same = text[1:] == text[:-1]
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])[same] if len(words) else words
    both = np.concatenate([words, pairs])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[1:][same]])


def _counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of grams by bucket, in all texts and in target texts: a table of fixed size."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            at, wanted = 0, batch.column(1).to_numpy(zero_copy_only=False)
            for part in chunks(batch.column(0).to_pylist()):
                bucket, text = grams(*word_hashes(part), buckets)
                every += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[wanted[at + text].astype(bool)], minlength=buckets)
                at += len(part)
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some]), pa.array(target[some])], names=["b", "n", "t"])

    rows = docs.select("text", "wanted").mapInArrow(apply, "b long, n long, t long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    every, target = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        every[r["b"]], target[r["b"]] = r["n"], r["t"]
    return every, target


def log_ratio(every: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability by bucket; each is smoothed by one part in all buckets."""
    if not target.sum():
        return np.zeros(len(every))
    p, q = (c + 1.0 for c in (target, every))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def log_weight(text: Column | str, ratio: np.ndarray) -> Column:
    """The log weight of a text column."""

    @F.pandas_udf("double")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for part in chunks(texts):
                bucket, text = grams(*word_hashes(part), len(ratio))
                out.append(np.bincount(text, ratio[bucket], minlength=len(part)))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    return apply(text)


def gumbel(seed: int, *cols: str) -> Column:
    """A Gumbel number from a hash of the columns."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(-F.log(u))


def largest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest key, without sorting them all: a histogram is narrowed until
    the bin that holds the last place has few rows, or one value."""
    facts = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if k >= facts["n"]:
        return rows
    if k <= 0:
        return rows.limit(0)
    low, high, inside, above = facts["low"], facts["high"], facts["n"], 0
    while inside > SORT_ROWS and low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width else F.lit(0)
        part = rows.filter(F.col(key).between(low, high)).groupBy(at.alias("bin"))
        bins = part.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["n"] == inside and (low, high) == (r["low"], r["high"]):
            break  # the bin cannot be narrowed any further
        low, high, inside = r["low"], r["high"], r["n"]
    # few different rows are left; equal ones are counted, so that they need no sorting
    alike = rows.filter(F.col(key).between(low, high)).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(F.desc(key), *[c for c in rows.columns if c != key])
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (
        alike.withColumn("_take", F.least(F.col("_n"), F.lit(k - above) - before))
        .filter("_take > 0")
        .withColumn("_take", F.explode(F.sequence(F.lit(1), F.col("_take"))))
        .select(*rows.columns)
    )
    return rows.filter(F.col(key) > high).unionByName(last)


def resample(
    docs: DataFrame, target_ids: DataFrame, share: float, id_col: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """``(id, mark, log_weight, key)`` of the sampled rows: ``share`` of all rows. ``target_ids``
    (column ``id``) names the target texts and must be a bounded sample: it is broadcast."""
    ids = F.broadcast(target_ids.select("id").distinct().withColumn("wanted", F.lit(True)))
    read = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    flagged = read.join(ids, "id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    ratio = log_ratio(*_counts(flagged, buckets))
    weighed = read.select("id", F.xxhash64("text").alias("mark"), log_weight("text", ratio).alias("log_weight"))
    keyed = cut(weighed.withColumn("key", F.col("log_weight") + gumbel(seed, "id", "mark")), "importance")
    return largest(keyed, "key", round(share * keyed.count()))

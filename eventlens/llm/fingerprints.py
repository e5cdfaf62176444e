"""Document fingerprints: one-permutation MinHash with densified bins.

The hashes of all runs of five words fall into bins by their highest bits; a bin keeps its
smallest. An empty bin takes the value of another, found by a fixed sequence of probes over all
bins that is its own (optimal densification). Of each bin the lowest bits are stored, packed. Two
fingerprints agree in a bin by chance in one of ``2 ** bits`` cases; the likeness corrects that.

Edge cases: a text without words (null, empty) has the empty fingerprint, which is like another
empty one (1) and like no other (0); a text with fewer than five words is one run; equal texts have
equal fingerprints; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .words import RUN, chunks, mix, run_hashes, word_hashes

BINS, BITS = 256, 4
_NONE = np.uint64(2**64 - 1)


def _donors(bins: int, attempt: int) -> np.ndarray:
    """Which bin each bin asks in an attempt."""
    x = np.arange(bins, dtype=np.uint64) + np.uint64(bins) * np.uint64(attempt)
    return (mix(x + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)


def bin_minima(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The smallest hash in each bin of each text, empty bins filled; texts without any stay empty."""
    text = np.repeat(np.arange(len(counts)), counts)
    high = np.uint64(64 - (bins.bit_length() - 1))
    table = np.full(len(counts) * bins, _NONE)
    np.minimum.at(table, text * bins + (values >> high).astype(np.int64), values)
    table = table.reshape(len(counts), bins)
    given = table != _NONE
    row, col = np.nonzero(~given & (counts > 0)[:, None])
    attempt = 0
    while len(row):
        donor = _donors(bins, attempt)[col]
        hit = given[row, donor]
        table[row[hit], col[hit]] = table[row[hit], donor[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return table


def sketches(texts: Iterable[str | None], bins: int = BINS, bits: int = BITS, run: int = RUN) -> Iterator[bytes]:
    """The packed fingerprint of each text; empty for a text without words."""
    for part in chunks(texts):
        values, counts = run_hashes(*word_hashes(part), run)
        low = (mix(bin_minima(values, counts, bins)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
        planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
        packed = np.packbits(planes.reshape(len(part), -1), axis=1, bitorder="little")
        for i in range(len(part)):
            yield packed[i].tobytes() if counts[i] else b""


def likeness(a: list[bytes], b: list[bytes], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The estimated Jaccard likeness of paired fingerprints, from 0 to 1."""
    out = np.fromiter((x == y for x, y in zip(a, b, strict=True)), np.float64, len(a))
    both = [i for i in range(len(a)) if a[i] and b[i]]
    if both:
        x, y = (np.frombuffer(b"".join(s[i] for i in both), np.uint8).reshape(len(both), -1) for s in (a, b))
        differ = np.unpackbits(x ^ y, axis=1, bitorder="little").reshape(len(both), bins, bits).any(axis=2)
        chance = 2.0**-bits
        out[both] = np.clip(((1 - differ.mean(axis=1)) - chance) / (1 - chance), 0, 1)
    return out


def fingerprint(texts: DataFrame, text: str, out: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``texts`` with a column of packed fingerprints."""

    @F.pandas_udf("binary")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(sketches(part, bins, bits)), dtype=object)

    return texts.withColumn(out, apply(text))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the head of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_FIELDS = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends like the head of the next
    document (ascending id, then a hash of the text; after the last comes the first).

    Documents are sorted by ranges. Within a range each row is met with the row after it; the last
    row of a range meets the first of the next one in a second step over these rows alone. A lone
    document is its own next. A null id comes first.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("mark", F.xxhash64("text"))
    n = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(n, "id", "mark").sortWithinPartitions("id", "mark").drop("mark")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kind", "part", "text"]
    types = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    spark_schema = f"id {id_type.simpleString()}, {_FIELDS}, kind int, part int, text string"

    def pairs(ids: list, texts: list[str], own: list[bytes], following: list[str], after: list[bytes]) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        sums = [hashlib.sha256(c.encode()).hexdigest() for c in changed]
        prints = list(sketches(changed))
        columns = [ids, list(map(len, texts)), sums, own, prints, likeness(own, prints), likeness(own, after), [0] * len(ids), [0] * len(ids), [None] * len(ids)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

    def edge(row: tuple, kind: int, part: int) -> pa.RecordBatch:
        values = [row[0], None, None, row[2], None, None, None, kind, part, row[1]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], schema=schema)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(all_ids), 512):
                ids, texts = all_ids[at : at + 512], all_texts[at : at + 512]
                own = list(sketches(texts))
                if last is None:
                    yield edge((ids[0], texts[0], own[0]), 1, part)
                else:
                    ids, texts, own = [last[0], *ids], [last[1], *texts], [last[2], *own]
                last = (ids[-1], texts[-1], own[-1])
                if len(ids) > 1:
                    yield pairs(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:])
        if last is not None:
            yield edge(last, 2, part)

    made = cut(ordered.mapInArrow(within, spark_schema), "fingerprints")
    # one row per range from here on
    firsts = made.filter("kind = 1").select("part", F.struct(F.col("text"), F.col("fingerprint")).alias("first"))
    lasts = made.filter("kind = 2").select("part", "id", "text", "fingerprint")
    # the numbers of the ranges alone are put in order; texts move by joins
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("part").over(by_part), F.first("part").over(whole))
    steps = firsts.select("part").select("part", after.alias("after_part"))
    heads = firsts.select(F.col("part").alias("after_part"), F.col("first").alias("following"))
    edges = lasts.join(steps, "part").join(heads, "after_part")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pairs(*(c.to_pylist() for c in batch.columns))

    rest = edges.select("id", "text", "fingerprint", F.col("following.text").alias("next"), F.col("following.fingerprint").alias("after"))
    rest = rest.mapInArrow(between, spark_schema)
    return made.filter("kind = 0").unionByName(rest).drop("kind", "part", "text")

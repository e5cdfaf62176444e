"""Nearest neighbours by cross-polytope hashing.

A unit vector is rotated pseudo-randomly (three times signs and a fast Hadamard transform) and
assigned to the nearest signed axis; every table rotates in its own way. A query looks into its
nearest axes of each table. What it finds there is ranked by the exact cosine of the original
vectors, in double precision, inside the bucket, so only a few rows per query and bucket move on.

A bucket, however large, is cut into blocks of rows and blocks of queries; how many is known from
one count per bucket, a table whose size the parameters fix. A query that finds fewer than ``k``
is compared with all rows, in blocks as well.

Edge cases: vectors that are null, empty, zero or hold null or non-finite numbers, or that have
another dimension than most, take no part, as do rows without an id; of rows with equal ids the
smallest vector counts; ties go to the smaller id; with fewer than ``k`` other rows all are found;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut, measured_cut

K, TABLES, PROBES, SEED = 5, 20, 4, 11
ROW_BLOCK, QUERY_BLOCK = 16_384, 1024
#: Scores that differ by less are computed once more, one by one.
MARGIN = 1e-9


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Rows rotated as ``table`` does; the dimension grows to a power of two."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([seed, table, size]).choice([-1.0, 1.0], (3, size))
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for sign in signs:
        y = y * sign
        step = 1
        while step < size:  # the Hadamard transform, by halves
            y = y.reshape(len(x), -1, 2, step)
            y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2)
            step *= 2
        y = y.reshape(len(x), size) / np.sqrt(size)
    return y


def axes(x: np.ndarray, table: int, probes: int = 1, seed: int = SEED) -> np.ndarray:
    """The nearest signed axes of each row, nearest first."""
    y = rotate(x, table, seed)
    both = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors stored as little-endian doubles, each brought to a size near 1 by a power of two: that
    changes no cosine, and no square overflows."""
    values = column.to_pylist()
    if not values:
        return np.empty((0, 0))
    x = np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, v)``: one usable vector per id, as bytes."""
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        "id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    one = cut(good.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    widths = one.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "v"])

    return one.filter(F.size("v") == width).mapInArrow(pack, "id long, v binary")


def _hashed(vectors: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """``(t, bucket, id, v)``: the nearest axes of each vector in each table."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1))
                for t in range(tables):
                    found = axes(x, t, probes, seed)
                    rows = np.repeat(np.arange(len(part)), found.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(found.ravel().astype(np.int32)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))],
                        names=["t", "bucket", "id", "v"],
                    )

    return vectors.mapInArrow(apply, "t int, bucket int, id long, v binary")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, each computed by itself."""
    dots = (q * x).sum(axis=1)
    return dots / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _nearest(k: int):
    """Over rows sorted by group, queries first: the ``k`` nearest rows of each query in its group."""

    def best(qid, q, xid, x) -> tuple[list, list, list]:
        unit_q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
        unit_x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        scores = unit_q @ unit_x.T
        scores[qid[:, None] == xid[None, :]] = -np.inf
        n = min(k, scores.shape[1])
        least = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
        rows, cols = np.nonzero((scores >= least[:, None] - MARGIN) & (scores > -np.inf))
        exact = cosines(q[rows], x[cols]) if len(rows) else np.empty(0)
        order = np.lexsort((xid[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        keep = place < k
        return qid[rows[keep]], xid[cols[keep]], exact[keep]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "bucket", "rb", "qb"]
        key, queries = None, None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            kind, ids = batch.column("kind").to_numpy(), batch.column("id").to_numpy()
            change = np.any(keys[1:] != keys[:-1], axis=1) | (kind[1:] != kind[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            for s, e in zip(edges, edges[1:], strict=False):
                here = tuple(keys[s].tolist())
                if here != key:
                    key, queries = here, None
                x = _matrix(batch.column("v").slice(s, e - s))
                if kind[s] == 0:  # a block has a bounded number of queries
                    queries = (ids[s:e], x) if queries is None else (np.append(queries[0], ids[s:e]), np.vstack([queries[1], x]))
                elif queries is not None:
                    for at in range(0, e - s, 4096):
                        found = best(*queries, ids[s:e][at : at + 4096], x[at : at + 4096])
                        yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query", "id", "score"])

    return apply


def _compared(rows: DataFrame, queries: DataFrame, k: int, row_block: int, query_block: int) -> DataFrame:
    """``(query, id, score)``: the nearest of each query in each bucket ``(t, bucket)``."""
    sizes = F.broadcast(  # a row per bucket: tables times axes
        rows.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / row_block).cast("int").alias("rbs"))
        .join(queries.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("qbs")), ["t", "bucket"])
    )

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = queries.join(sizes, ["t", "bucket"]).withColumn("kind", F.lit(0)).withColumn("qb", part("qbs")).withColumn("rb", every("rbs"))
    r = rows.join(sizes, ["t", "bucket"]).withColumn("kind", F.lit(1)).withColumn("rb", part("rbs")).withColumn("qb", every("qbs"))
    group = ["t", "bucket", "rb", "qb"]
    both = q.select(*group, "kind", "id", "v").unionByName(r.select(*group, "kind", "id", "v"))
    return both.repartition(*group).sortWithinPartitions(*group, "kind", "id").mapInArrow(_nearest(k), "query long, id long, score double")


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K,
    tables: int = TABLES, probes: int = PROBES, seed: int = SEED,
    row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row for which
    ``is_query`` (an expression over ``id``) holds."""
    usable = cut(_usable(vectors, id_col, vector), "usable")
    queries = usable.filter(is_query)
    found = _compared(_hashed(usable, tables, 1, seed), _hashed(queries, tables, probes, seed), k, row_block, query_block)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def top(rows: DataFrame) -> DataFrame:
        return rows.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = cut(top(found), "found")
    few = queries.join(first.groupBy("query").count().filter(F.col("count") >= k).select(F.col("query").alias("id")), "id", "left_anti")
    few, facts = measured_cut(few, "few", n=F.count(F.lit(1)))
    if facts["n"]:
        whole = [F.lit(-1).alias("t"), F.lit(0).alias("bucket"), "id", "v"]
        more = _compared(usable.select(*whole), few.select(*whole), k, row_block, query_block)
        first = top(first.drop("rank").unionByName(more))
    return first.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")

"""Random-hyperplane signatures, their buckets and candidates.

A hyperplane has one sign per term, and the sign is a bit of a digest of the term: nothing has to
be stored or shipped, whatever the number of functions. Function ``i`` belongs to table
``i % bands``; a table's signature is its bits in function order.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, measured_cut
from ..skew import HEAVY_ROWS, group_pairs, skew_join

ROWS = 4
BANDS = 4
SEED = 42
DIGITS = 9

BITS_PER_DIGEST = 240
#: Documents whose products are taken at once.
HASHED_ROWS = 4000


def sign_digest(term: Column, block: int, seed: int = SEED) -> Column:
    """A SHA-256 digest of a term as hex text; its first 240 bits are the signs of one block of
    functions."""
    return F.sha2(F.concat(F.lit(f"{seed}.{block}:"), term), 256)


def sign_bit(digest: Column, function: int) -> Column:
    """1 if the hyperplane of ``function`` has +1 for the term, 0 if it has -1."""
    place = function % BITS_PER_DIGEST
    digit = F.conv(F.substring(digest, place // 4 + 1, 1), 16, 10).cast("int")
    return F.shiftright(digit, 3 - place % 4).bitwiseAND(F.lit(1))


@functools.lru_cache(1 << 18)
def _digests(term: str, blocks: int, seed: int) -> bytes:
    parts = (hashlib.sha256(f"{seed}.{b}:{term}".encode()).digest() for b in range(blocks))
    return b"".join(part[: BITS_PER_DIGEST // 8] for part in parts)


def _signs(terms: list[str], count: int, seed: int) -> np.ndarray:
    """Whether each function's hyperplane has +1 for each term; a row per term."""
    blocks = (count + BITS_PER_DIGEST - 1) // BITS_PER_DIGEST
    digests = b"".join([_digests(t, blocks, seed) for t in terms])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(terms), -1), axis=1)
    return bits[:, :count].astype(bool)


def _packed_bits(packed: DataFrame, rows: int, bands: int, seed: int) -> DataFrame:
    """``(id, bits)`` of rows ``(id, terms, w)``: two arrays of one length, null where there is no vector."""
    count, names = rows * bands, ["id", "bits"]

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, HASHED_ROWS):
                some = batch.slice(begin, HASHED_ROWS)
                terms, w = some.column("terms"), some.column("w").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(some)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
                coded = terms.flatten().dictionary_encode()
                # null terms and weights add nothing
                known = coded.indices.is_valid().to_numpy(zero_copy_only=False) & some.column("w").flatten().is_valid().to_numpy(zero_copy_only=False)
                code = coded.indices.fill_null(0).to_numpy()[known]
                row, w = row[known], w[known]
                bits = np.zeros((len(some), count), np.uint8)
                if len(w):
                    signs = np.ascontiguousarray(_signs(coded.dictionary.to_pylist(), count, seed).T)
                    for i in range(count):
                        dot = np.bincount(row, np.where(signs[i][code], w, -w), len(some))
                        # as the sum rounded to DIGITS; Spark orders NaN above all numbers
                        bits[:, i] = (dot >= 0.5 * 10.0**-DIGITS) | np.isnan(dot)
                texts = [b.tobytes().decode() for b in bits + ord("0")]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(texts, pa.string())], names=names)

    return packed.select("id", "terms", "w").mapInArrow(of_batch, f"id {packed.schema['id'].dataType.simpleString()}, bits string")


def hash_bits(vectors: DataFrame, rows: int = ROWS, bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """``(id, bits)`` of vectors ``(id, term, w)``: one bit per function, 1 where the dot product is above
    zero. Null terms and weights add nothing. A document's terms are gathered; the products are taken in batches
    of documents, for which each term's signs are found once."""
    entries = F.collect_list(F.struct("term", F.col("w").cast("double").alias("w")))
    packed = vectors.groupBy("id").agg(entries.alias("e"))
    return _packed_bits(packed.select("id", F.col("e.term").alias("terms"), F.col("e.w").alias("w")), rows, bands, seed)


def profile_bits(profiles: DataFrame, rows: int = ROWS, bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """``(id, bits)`` of profiles ``(id, entries)``; ids are unique, a profile without entries has no bit set."""
    packed = profiles.select("id", F.col("entries.term").alias("terms"), F.col("entries.w").cast("array<double>").alias("w"))
    return _packed_bits(packed, rows, bands, seed)


def profile_signatures(profiles: DataFrame, rows: int, bands: int, seed: int = SEED) -> DataFrame:
    """``(id, sigs)`` of profiles."""
    bits = profile_bits(profiles, rows, bands, seed)
    return bits.select("id", band_signatures(F.col("bits"), rows, bands).alias("sigs"))


def band_signatures(bits: Column, rows: int, bands: int) -> Column:
    """The signatures of all tables as one array."""
    return F.array(
        *[
            F.concat(*[F.substring(bits, 1 + table + r * bands, 1) for r in range(rows)])
            for table in range(bands)
        ]
    )


def signatures(vectors: DataFrame, rows: int = ROWS, bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """``(id, sigs)`` of vectors."""
    bits = hash_bits(vectors, rows, bands, seed)
    return bits.select("id", band_signatures(F.col("bits"), rows, bands).alias("sigs"))


def hash_tables(sigs: DataFrame) -> DataFrame:
    """``(table_id, sig, id)``."""
    return sigs.select(F.posexplode("sigs").alias("table_id", "sig"), "id").select(
        "table_id", "sig", "id"
    )


def build(vectors: DataFrame, rows: int = ROWS, bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """Hash tables of vectors ``(id, term, w)``."""
    return hash_tables(signatures(vectors, rows, bands, seed))


def table_signatures(tables: DataFrame) -> DataFrame:
    """``(id, sigs)`` of hash tables: an id's signatures in the order of the tables."""
    rows = tables.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("table_id", "sig"))).alias("rows"))
    return rows.select("id", F.transform("rows", lambda r: r["sig"]).alias("sigs"))


def add(tables: DataFrame, vectors: DataFrame, rows: int, bands: int, seed: int = SEED) -> DataFrame:
    """Hash tables with the rows of new vectors."""
    return tables.unionByName(build(vectors, rows, bands, seed))


def remove(tables: DataFrame, ids: DataFrame) -> DataFrame:
    """Hash tables without the rows of ``ids``."""
    return tables.join(ids.select("id").distinct(), "id", "left_anti").select("table_id", "sig", "id")


def bucket_index(tables: DataFrame) -> DataFrame:
    """``(table_id, sig, n, first_id, last_id)``: the size and id range of every bucket. Its
    members are the rows of ``tables`` with that key, or the chunks of ``bucket_members``."""
    return tables.groupBy("table_id", "sig").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


#: Members of a chunk, at most.
CHUNK = 1024


def bucket_members(tables: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(table_id, sig, first_id, n, gaps)``: the posting lists of all buckets, in chunks of up to ``chunk``
    members in ascending order. ``gaps`` are the differences of each id from the one before; the first is 0.

    Rows are sorted by ranges of bucket and id, so a crowded bucket is spread over tasks and no window holds
    more than the rows of a range. Chunks of a bucket do not overlap; equal rows count each. Ids are whole
    numbers; rows with a null id are in no bucket.
    """
    spark = tables.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = tables.filter("id IS NOT NULL").select("table_id", "sig", F.col("id").cast("bigint").alias("id"))
    ranged = rows.repartitionByRange(ranges, "table_id", "sig", "id").withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy("table_id", "sig", "_range").orderBy("id")
    placed = ranged.withColumn("_chunk", F.floor((F.row_number().over(own) - 1) / chunk))
    chunks = placed.groupBy("table_id", "sig", "_range", "_chunk").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    before = F.concat(F.slice("ids", 1, 1), F.slice("ids", 1, F.size("ids") - 1))
    return chunks.select(
        "table_id", "sig", F.element_at("ids", 1).alias("first_id"), F.size("ids").alias("n"),
        F.zip_with("ids", before, lambda i, last: i - last).alias("gaps"),
    )


def expand_members(chunks: DataFrame) -> DataFrame:
    """``(table_id, sig, id)`` of the chunks of ``bucket_members``, each read by itself."""
    read = F.struct(F.col("first_id").alias("id"), F.array().cast("array<bigint>").alias("ids"))
    ids = F.aggregate(
        "gaps", read,
        lambda s, gap: F.struct((s["id"] + gap).alias("id"), F.array_append(s["ids"], s["id"] + gap).alias("ids")),
    )["ids"]
    return chunks.select("table_id", "sig", F.explode(ids).alias("id"))


def inverted(tables: DataFrame) -> DataFrame:
    """``(id, buckets)``: the buckets of an id as sorted ``table-signature`` keys; one per table."""
    key = F.concat_ws("-", F.col("table_id").cast("string"), "sig")
    return tables.groupBy("id").agg(F.array_sort(F.collect_set(key)).alias("buckets"))


def candidates(
    tables: DataFrame, queries: DataFrame, keep_self: bool = False, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """``(query_id, id, shared)``: the ids in the buckets of some query rows ``(table_id, sig,
    id)`` and the number of buckets shared. The tables are the large side; a crowded bucket is
    split. Meant for given queries; ``candidate_counts`` and the similarity join cover all ids."""
    wanted = queries.select("table_id", "sig", F.col("id").alias("query_id")).distinct()
    hits = skew_join(tables, wanted, ["table_id", "sig"], heavy_rows=heavy_rows)
    if not keep_self:
        hits = hits.filter("id <> query_id")
    return hits.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("shared"))


#: Up to so many tables, distinct counts come from the sizes of all ``2^tables - 1`` intersections.
SUBSET_TABLES = 6


def _table_subsets(bands: int) -> list[tuple[int, ...]]:
    return [s for k in range(1, bands + 1) for s in itertools.combinations(range(bands), k)]


def _subset_rows(sigs: DataFrame, bands: int) -> DataFrame:
    """Each id once per set of tables, with the joint key of its signatures there and the sign the
    set has in an inclusion-exclusion sum."""
    subsets = [
        F.struct(
            F.lit(number).alias("subset"),
            F.lit(1 if len(tables) % 2 else -1).alias("sign"),
            F.lit(len(tables) == 1).alias("single"),
            F.concat_ws("-", *[F.element_at("sigs", t + 1) for t in tables]).alias("key"),
        )
        for number, tables in enumerate(_table_subsets(bands))
    ]
    return sigs.select("id", F.inline(F.array(*subsets)))


def raw_counts(sigs: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``(id, n_raw)``: candidates of every id, itself left out, counted once per shared bucket. It
    takes bucket sizes alone, so it is linear whatever the number of tables."""
    tables = cut(hash_tables(sigs), "tables")
    sizes = tables.groupBy("table_id", "sig").agg((F.count(F.lit(1)) - 1).alias("others"))
    joined = skew_join(tables, sizes, ["table_id", "sig"], heavy_rows=heavy_rows)
    return joined.groupBy("id").agg(F.sum("others").alias("n_raw"))


#: Bits of a signature that fit a number.
CODE_BITS = 60


def _met_groups(sigs: DataFrame, bands: int) -> tuple[DataFrame, DataFrame]:
    """Groups ``(sigs, group, n)`` of ids with equal signatures in all tables, and pairs of groups
    ``(id_a, n_a, id_b, n_b)`` that share a bucket, each in the first table it shares.

    Pairs of groups in a bucket are its square; a large one is laid out in squares of parts. They
    are summed up, never stored. Rows are small and pairs are compared by compiled code: signatures go as numbers, a
    column each, unless they are too long for that.
    """
    fits = F.forall("sigs", lambda s: F.coalesce(s.rlike(f"^[01]{{0,{CODE_BITS}}}$"), F.lit(True)))
    groups, seen = measured_cut(
        sigs.groupBy("sigs").agg(F.min("id").alias("group"), F.count(F.lit(1)).alias("n")), "groups", long=F.count_if(~fits)
    )

    def code(t: int) -> Column:
        sig = F.get("sigs", F.lit(t))
        return sig if seen["long"] else F.conv(F.concat(F.lit("1"), sig), 2, 10).cast("bigint")

    coded = groups.select(F.col("group").alias("id"), "n", *[code(t).alias(f"s{t}") for t in range(bands)])
    codes = [f"s{t}" for t in range(bands)]
    rows = cut(coded.select(F.posexplode(F.array(*codes)).alias("table_id", "sig"), "id", "n", *codes), "group-rows")
    pairs = group_pairs(rows, ["table_id", "sig"], "id")
    met_before = [
        (F.col("table_id") > t) & F.coalesce(F.col(f"s{t}_a") == F.col(f"s{t}_b"), F.lit(False)) for t in range(bands - 1)
    ]
    return groups, pairs.filter(~functools.reduce(operator.or_, met_before, F.lit(False))).select("id_a", "n_a", "id_b", "n_b")


def candidate_counts(sigs: DataFrame, bands: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``(id, n_raw, n_distinct)`` for every id, itself left out: candidates counted once per
    shared bucket, and once each.

    With few tables no pair is built: the distinct count is the size of a union of buckets, which
    follows from the sizes of their intersections, ids that agree on a set of tables. With more,
    groups of ids with equal signatures meet in their buckets, which is quadratic in the groups of
    a bucket; ``raw_counts`` is not.
    """
    if bands > SUBSET_TABLES:
        groups, pairs = _met_groups(sigs, bands)
        sums = pairs.select(F.col("id_a").alias("group"), F.col("n_b").alias("m")).unionByName(
            pairs.select(F.col("id_b").alias("group"), F.col("n_a").alias("m"))
        ).groupBy("group").agg(F.sum("m").alias("m"))
        counted = groups.join(sums, "group", "left").select(
            "sigs", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_distinct")
        )
        return sigs.join(counted, "sigs").select("id", "n_distinct").join(raw_counts(sigs, heavy_rows), "id").select(
            "id", "n_raw", "n_distinct"
        )
    rows = cut(_subset_rows(sigs, bands), "subset-rows")
    sizes = rows.groupBy("subset", "key").agg((F.count(F.lit(1)) - 1).alias("others"))
    return (
        skew_join(rows, sizes, ["subset", "key"], heavy_rows=heavy_rows)
        .groupBy("id")
        .agg(
            F.sum(F.when(F.col("single"), F.col("others")).otherwise(0)).alias("n_raw"),
            F.sum(F.col("sign") * F.col("others")).alias("n_distinct"),
        )
    )


def pair_counts(sigs: DataFrame, bands: int) -> DataFrame:
    """One row ``(raw_pairs, distinct_pairs)``: unordered pairs over all buckets, counted per
    bucket and once each; from group sizes alone, or from pairs of groups, as above."""
    n = F.col("n").cast("decimal(19,0)")
    within = (n * (n - 1) / 2).cast("decimal(38,0)")
    if bands > SUBSET_TABLES:
        groups, pairs = _met_groups(sigs, bands)
        buckets = hash_tables(sigs).groupBy("table_id", "sig").agg(F.count(F.lit(1)).alias("n"))
        raw = buckets.agg(F.coalesce(F.sum(within), F.lit(0)).cast("bigint").alias("raw_pairs"))
        own = groups.select(within.alias("pairs"))
        across = pairs.select((F.col("n_a").cast("decimal(19,0)") * F.col("n_b")).cast("decimal(38,0)").alias("pairs"))
        distinct = own.unionByName(across).agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("distinct_pairs"))
        return raw.join(F.broadcast(distinct))  # one row each
    groups = (
        _subset_rows(sigs, bands)
        .groupBy("subset", "sign", "single", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pairs", within)
    )
    return groups.agg(
        F.sum(F.when(F.col("single"), F.col("pairs")).otherwise(0)).cast("bigint").alias("raw_pairs"),
        F.sum(F.col("sign") * F.col("pairs")).cast("bigint").alias("distinct_pairs"),
    )

"""Event clustering: dated texts grouped by what they say, what they mention and when."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import boosted_text, tokenize
from ..session import cut, spread
from ..skew import HEAVY_ROWS, skew_join
from . import features as V
from . import lsh, similar
from .blockpairs import band_pairs, cosine_pairs
from .density import LEAF_PAIRS, Clustering, density_clusters, find_neighbors

MIN_PTS = 20
EPS = 0.35
ROWS = 13
BANDS = 10
#: Cosine from which on exact neighbours are found by common terms where they need not have one.
INDEX_FROM = 0.2


def default_tokens() -> Column:
    """Tokens of a tweet's text with its hashtags once more."""
    return tokenize(boosted_text(F.col("text"), F.col("split_hashtags"), F.col("hashtags")))


def event_clusters(
    tweets: DataFrame,
    min_pts: int = MIN_PTS,
    eps: float = EPS,
    *,
    candidates: str = "lsh",
    rows: int = ROWS,
    bands: int = BANDS,
    seed: int = lsh.SEED,
    model: Any = None,
    time_decay: str = "hours",
    count_mode: str = "distinct",
    border: str = "bridge",
    score_tokens: Column | None = None,
    lsh_tokens: Column | None = None,
    resources: DataFrame | None = None,
    resource_similarity: S.Similarity = S.any_resource,
    index_from: float = INDEX_FROM,
    bucket_rows: int = similar.BUCKET_ROWS,
    leaf_pairs: int = LEAF_PAIRS,
    heavy_rows: int = HEAVY_ROWS,
) -> Clustering:
    """Cluster ``tweets`` ``(id, text, created_at, hashtags, split_hashtags)``.

    Two tweets are neighbours when they are candidates (``'lsh'``: equal signature in a table;
    ``'exact'``: every pair) and ``1 - time * (cos + entities) / 2 <= eps``. A core has more than
    ``min_pts`` neighbours and counts itself; ``count_mode='bands'`` counts a neighbour once per
    shared table. With a ``model`` (as ``store.load_model`` returns it) its hash tables and their
    number are used instead of new ones; tweets it does not have are noise. ``resources`` holds ``(id, resources)`` arrays of ``(uri, in_links)``.

    From ``eps`` 0.5 on, exact neighbours need no common term. Whatever they say, tweets are neighbours up to some
    hours apart; that is settled by time alone, in boxes of all tweets. Pairs further apart need a cosine above
    0: those from ``index_from`` on share a term of the index, those below it must lie in a band of time and are
    compared there. Neighbours that both ways find are counted once.

    Tweets with equal tokens and resources in one stretch of time form a cell. Vectors,
    signatures and similarities are computed once per cell, so a text that was copied a million
    times costs as much as one; the copies' times are settled by ``density``.
    """
    wide = eps >= 0.5 and candidates == "exact"
    if wide and resources is not None:
        raise ValueError("from eps 0.5 on, exact candidates need equal entities")
    if count_mode not in ("distinct", "bands") or candidates not in ("lsh", "exact"):
        raise ValueError("unknown count_mode or candidates")
    if count_mode == "bands" and candidates == "exact":
        raise ValueError("exact candidates have no tables to count")
    if model is not None:
        if candidates == "exact" or lsh_tokens is not None:
            raise ValueError("a model brings its own signatures")
        rows, bands = model.rows, model.bands
    threshold = 1.0 - 2.0 * eps
    decays = time_decay == "hours"

    def hours_apart(cos: float) -> float:
        """The hours that two texts may at most be apart, with equal entities."""
        return S.DECAY_HOURS * (1.0 - 2.0 * (1.0 - eps) / (1.0 + cos)) + 1e-6

    # even at the highest similarity
    reach = hours_apart(1.0)

    score = default_tokens() if score_tokens is None else score_tokens
    keep = ["hours", "resources"] + (["lsh_tokens"] if lsh_tokens is not None else [])
    given = tweets.withColumn("hours", S.hours(F.col("created_at")))
    empty = "CAST(array() AS array<struct<uri string, in_links array<string>>>)"
    if resources is None:
        given = given.withColumn("resources", F.expr(empty))
    else:
        given = given.join(resources.select("id", "resources"), "id", "left")
        given = given.withColumn("resources", F.coalesce("resources", F.expr(empty)))
    if lsh_tokens is not None:
        given = given.withColumn("lsh_tokens", lsh_tokens)
    kept = V.token_rows(given, "id", score, keep=keep)

    def bag(col: str) -> Column:
        return F.array_join(F.array_sort(col), " ")

    links = F.transform(F.array_sort("resources"), lambda r: F.to_json(r))
    parts = [bag("tokens"), F.array_join(links, " ")] + ([bag("lsh_tokens")] if lsh_tokens is not None else [])
    # cells whose members are compared by time bands must be short
    stretch = hours_apart(index_from) if wide else reach
    block = F.floor(F.col("hours") / stretch) if decays else F.lit(0).cast("bigint")
    stored = cut(
        kept.withColumns({"content": F.sha2(F.concat_ws("\n", *parts), 256), "block": block}), "tokens"
    )
    heads = cut(
        stored.groupBy("content", "block").agg(
            F.min("id").alias("cell"), F.count(F.lit(1)).alias("copies"), F.min("hours").alias("lo"), F.max("hours").alias("hi")
        ),
        "heads",
    )
    head_rows = stored.join(heads.select(F.col("cell").alias("id"), "copies"), "id")

    tf = cut(V.term_freq(head_rows, "copies"), "tf")
    vectors = V.tfidf(tf, copies="copies", heavy_rows=heavy_rows)
    profiles = cut(V.profiles(vectors), "profiles")
    blocks = heads.select(F.col("cell").alias("id"), "block")
    cells = profiles.select("id")
    # pairs too far apart for their cosine, were their entities equal, are neighbours in no member
    times = heads.select(F.col("cell").alias("id"), "lo", "hi") if decays and resources is None else None
    hours = hours_apart if times is not None else None
    if candidates == "lsh":
        hashed = profiles
        if lsh_tokens is not None:
            other = head_rows.drop("tokens").withColumnRenamed("lsh_tokens", "tokens")
            other = other.filter(F.size("tokens") >= V.MIN_TOKENS)
            other_tf = cut(V.term_freq(other, "copies"), "lsh-tf")
            hashed = cut(V.profiles(V.tfidf(other_tf, copies="copies", heavy_rows=heavy_rows)), "lsh-profiles")
        if model is None:
            sigs = lsh.profile_signatures(spread(hashed), rows, bands, seed)
        else:
            sigs = lsh.table_signatures(model.tables.join(profiles.select("id"), "id", "left_semi"))
        sigs = cut(sigs, "signatures")
        cells = cells.join(sigs.select("id"), "id")
        # equal signatures are found within pairs of tiles, in the buckets that two tiles have in common
        scored = cosine_pairs(profiles, threshold, stretches=blocks, sigs=sigs, times=times, most_hours=hours)
    elif wide:
        scored = _wide_pairs(profiles, times, index_from, reach, stretch, hours_apart) if decays else None
    else:
        scored = cosine_pairs(profiles, threshold, stretches=blocks, times=times, most_hours=hours).withColumn("shared", F.lit(1))
    cells = cut(cells, "cells")
    pairs = cells.select(
        F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cos"),
        F.lit(bands if candidates == "lsh" else 1).alias("shared"),
    )
    if scored is not None:
        pairs = pairs.unionByName(scored.filter(S.may_be_close(F.col("cos"), eps)).select("a", "b", "cos", "shared"))
    if resources is None:
        pairs = pairs.withColumn("semantic", F.lit(1.0))
    else:
        sets = cut(head_rows.select("id", "resources"), "resource-sets")
        pairs = cut(pairs, "scored")
        pairs = skew_join(pairs, sets.selectExpr("id AS a", "resources AS ra"), ["a"], heavy_rows=heavy_rows)
        pairs = pairs.join(sets.selectExpr("id AS b", "resources AS rb"), "b").withColumn(
            "semantic", S.semantic_similarity(F.col("ra"), F.col("rb"), resource_similarity)
        )
    cell_pairs = cut(
        pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "cos", "semantic", "shared"),
        "cell-pairs",
    )
    # cells without a vector go before the join, whose keys the copies make uneven
    lasting = heads.join(cells.select(F.col("id").alias("cell")), "cell")
    dated = stored.select("id", "hours", "content", "block")
    members = cut(
        skew_join(dated, lasting, ["content", "block"], heavy_rows=heavy_rows).select("id", "cell", "hours"),
        "members",
    )

    def within(diffs: list[Column], attr) -> Column:
        time = S.time_similarity(diffs[0]) if decays else F.lit(1.0)
        return S.text_distance(time, attr("cos"), attr("semantic")) <= eps

    coords = ["hours"] if decays else []
    if wide:
        # all tweets are one cell, whose pairs are neighbours whatever their cosine
        everyone = cut(members.withColumn("cell", F.lit(0).cast("bigint")), "everyone")
        zero = F.lit(0).cast("bigint")
        whole = cell_pairs.sparkSession.range(1).select(
            zero.alias("ca"), zero.alias("cb"), F.lit(0.0).alias("cos"), F.lit(1.0).alias("semantic"), F.lit(1).alias("shared")
        )
        by_time = find_neighbors(everyone, whole, within, coords, stretch / 2, leaf_pairs, heavy_rows)
        if not decays:
            return density_clusters(by_time, min_pts, core_rule="gt", border=border, self_weight=1)
        by_text = find_neighbors(members, cell_pairs, within, coords, reach / 2, leaf_pairs, heavy_rows)

        def within_all(diffs: list[Column], attr) -> Column:
            return S.text_distance(S.time_similarity(diffs[0]), F.lit(0.0), attr("semantic")) <= eps

        in_both = find_neighbors(members, cell_pairs, within_all, coords, reach / 2, leaf_pairs, heavy_rows)
        return density_clusters(
            by_time, min_pts, core_rule="gt", border=border, self_weight=1, more=by_text, in_both=in_both
        )
    found = find_neighbors(members, cell_pairs, within, coords, reach / 2, leaf_pairs, heavy_rows)
    bands_counted = count_mode == "bands"
    return density_clusters(
        found,
        min_pts,
        core_rule="gt",
        border=border,
        weight="shared" if bands_counted else None,
        self_weight=bands if bands_counted else 1,
    )


def _wide_pairs(
    profiles: DataFrame, times: DataFrame, index_from: float, reach: float, stretch: float, hours_apart: Callable[[Any], Any]
) -> DataFrame:
    """``(a, b, cos, shared)`` of all cells with a cosine above 0 of which some members may be neighbours and
    more hours apart than any two may be."""
    blocks = times.select("id", F.floor(F.col("lo") / F.lit(reach + stretch)).alias("block"))
    indexed = cosine_pairs(profiles, index_from, stretches=blocks, times=times, most_hours=hours_apart)
    banded = band_pairs(profiles, times, index_from, hours_apart(0.0) - 2e-6, stretch, hours_apart)
    return indexed.unionByName(banded).withColumn("shared", F.lit(1))

"""Annotating whole collections and attaching knowledge-base resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions.text import pinned, word_pieces, word_start
from ..session import cut
from ..skew import skew_join


def annotate(texts: DataFrame) -> DataFrame:
    """``(id, annotations)`` of ``(id, response, tagged)``."""
    return texts.select("id", A.parse_annotations(F.col("response"), F.col("tagged")).alias("annotations"))


#: Bits of the filter that texts ask before the join, whatever the size of the gazetteer.
FILTER_BITS = 1 << 20


def _mark(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(FILTER_BITS)).cast("int")


def _marks(surfaces: DataFrame) -> DataFrame:
    """One row ``(marks)``: ``FILTER_BITS`` bits as an array of integers, set for the first word and the whole
    of every surface. A fuller filter lets more spans pass, and none of the gazetteer's is ever kept back."""
    first = F.substring_index("surface", " ", 1)
    own = surfaces.select(F.explode(F.array(_mark(first), _mark(F.col("surface"), F.lit(1)))).alias("mark"))
    bit = F.expr("shiftleft(1L, mark % 64)")
    empty = surfaces.sparkSession.range(FILTER_BITS // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = own.select(F.expr("CAST(mark DIV 64 AS bigint)").alias("word"), bit.alias("bits")).unionByName(empty)
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("marks"))


def likely_spans(texts: DataFrame, surfaces: DataFrame, max_words: int) -> DataFrame:
    """``(id, surface, start)``: spans of up to ``max_words`` words, in lower case, that may be among the
    ``surfaces``. They are found within the row: words are asked for first, spans that begin with a
    likely one after that."""
    # of a fixed size, so it may become a constant of the plan
    bits = _marks(surfaces).first()["marks"]
    marks = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")

    def marked(mark: Column) -> Column:
        return F.getbit(F.get(marks, F.floor(mark / 64).cast("int")), mark % 64) == 1

    pieces = pinned(word_pieces(texts, "id", "text"), words=F.transform("tokens", F.lower)).drop("tokens")
    firsts = F.filter(F.transform("words", lambda w, i: F.when(marked(_mark(w)), i)), lambda i: i.isNotNull())
    pieces = pinned(pieces, firsts=firsts)

    def spans(n: int) -> Column:
        inside = F.filter("firsts", lambda i: i + n <= F.size("words"))
        named = F.transform(
            inside, lambda i: F.struct(F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("surface"), i.alias("pos"))
        )
        return F.filter(named, lambda s: marked(_mark(s["surface"], F.lit(1))))

    every = F.concat(*[spans(n) for n in range(1, max_words + 1)])
    rows = F.transform(every, lambda s: F.struct(s["surface"].alias("surface"), word_start(s["pos"]).alias("start")))
    return pieces.select("id", F.inline(rows))


def link_entities(texts: DataFrame, gazetteer: DataFrame, max_words: int = 3) -> DataFrame:
    """``(id, surface, start, kind, uri)``: spans of up to ``max_words`` words of ``(id, text)``
    that a gazetteer ``(surface, uri, types, score, second_rank)`` names, in lower case.

    A filter of fixed size, asked within the row, leaves the spans that the gazetteer may hold; only they are
    joined with it, and a very common one is split over tasks. Null and empty texts have no spans, a
    null surface names nothing; repeated rows of the gazetteer, and entities of one surface, are all returned.
    """
    accepted = gazetteer.filter(
        A.convincing(F.col("score"), F.col("second_rank"))
        & A.wanted_entity(F.col("uri"), F.col("surface"))
    )
    named = accepted.filter("surface IS NOT NULL").select("surface").distinct()
    rows = cut(likely_spans(texts, named, max_words), "spans")
    return skew_join(rows, accepted, ["surface"]).select(
        "id", "surface", "start", A.annotation_kind(F.col("types")).alias("kind"), "uri"
    )


def attach_resources(uris: DataFrame, page_links: DataFrame) -> DataFrame:
    """``(id, resources)`` of ``(id, uris)``: the known resources of each row as a set of ``(uri,
    in_links)``, links as a set; a row without any keeps an empty array."""
    wanted = cut(uris.select("id", F.explode(F.array_distinct("uris")).alias("uri")), "uris")
    known = page_links.select("uri", F.array_sort(F.array_distinct("in_links")).alias("in_links"))
    sets = (
        skew_join(wanted, known, ["uri"])
        .groupBy("id")
        .agg(F.array_sort(F.collect_set(F.struct("uri", "in_links"))).alias("resources"))
    )
    none = F.expr("CAST(array() AS array<struct<uri string, in_links array<string>>>)")
    return uris.select("id").join(sets, "id", "left").select(
        "id", F.coalesce("resources", none).alias("resources")
    )


def find_resources(uris: DataFrame, page_links: DataFrame) -> DataFrame:
    """``(uri, in_links)`` for given uris; null links where the uri is unknown."""
    known = page_links.select("uri", F.array_sort(F.array_distinct("in_links")).alias("in_links"))
    return uris.select("uri").distinct().join(known, "uri", "left")

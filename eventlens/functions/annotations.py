"""Entity annotations: reading, typing and filtering what an entity-linking service returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acceptance bounds.
MIN_SCORE = 0.8
MAX_SECOND_RANK = 0.5

# Resources and surfaces that are never kept; surfaces in any case.
UNWANTED_URIS = """
http://dbpedia.org/resource/Google http://dbpedia.org/resource/Twitter
http://dbpedia.org/resource/World http://dbpedia.org/resource/Noon
http://dbpedia.org/resource/Girl http://dbpedia.org/resource/Update_(SQL)
http://dbpedia.org/resource/Video http://dbpedia.org/resource/Music
http://dbpedia.org/resource/Adobe_Premiere_Pro
""".split()
STOP_SURFACES = "SURPRISE YOUTUBE VIMEO TWITTER DAY THURSDAY OURSELVES".split()

KINDS = ["Where", "Who", "What", "When"]

RESPONSE_SCHEMA = (
    "Resources array<struct<`@surfaceForm`: string, `@URI`: string, `@offset`: string, "
    "`@similarityScore`: string, `@percentageOfSecondRank`: string, `@types`: string>>"
)
ANNOTATION_SCHEMA = "struct<surface: string, start: int, kind: string, uri: string>"
TAGGED_SCHEMA = (
    "array<struct<`begin`: int, `end`: int, `word`: string, `tag`: string, `lemma`: string>>"
)


def annotation_kind(types: Column) -> Column:
    """Kind of an entity from its comma-separated types; the first rule that applies."""
    names = F.split(F.coalesce(types, F.lit("")), ",")

    def has(name: str) -> Column:
        return F.array_contains(names, f"DBpedia:{name}")

    return (
        F.when(has("Place"), "Where")
        .when(has("Person") | has("Organisation"), "Who")
        .when(has("Time"), "When")
        .otherwise("What")
    )


def noun_begins(tagged: Column) -> Column:
    """``(begins, steps)``: where the nouns of a tagged text begin, ascending, and the powers of two below their
    number, descending: what ``span_has_noun`` searches. To be taken once per text."""
    nouns = F.filter(tagged, lambda t: t["tag"].startswith("N") & t["begin"].isNotNull())
    begins = F.array_sort(F.transform(nouns, lambda t: t["begin"]))
    last = F.length(F.bin(F.size(nouns))) - 1
    steps = F.transform(F.sequence(last, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.struct(begins.alias("begins"), steps.alias("steps"))


def span_has_noun(start: Column, surface: Column, nouns: Column) -> Column:
    """A noun begins between ``start`` and ``start`` + length of the surface, both included. ``nouns`` are the text's
    ``noun_begins``, halved until the first one not before ``start`` is found."""
    begins, end = nouns["begins"], start + F.length(surface)
    before = F.aggregate(
        nouns["steps"], F.lit(0),
        lambda pos, step: F.when(F.get(begins, pos + step - 1) < start, pos + step).otherwise(pos),
    )
    first = F.get(begins, before)
    return F.when(begins.isNotNull(), F.coalesce(first <= end, F.when(first.isNull(), False)))


def wanted_entity(uri: Column, surface: Column) -> Column:
    return ~uri.isin(UNWANTED_URIS) & ~F.upper(surface).isin(STOP_SURFACES)


def convincing(score: Column, second_rank: Column) -> Column:
    return (score > MIN_SCORE) & (second_rank <= MAX_SECOND_RANK)


def parse_annotations(response: Column, tagged: Column) -> Column:
    """Annotations of one text: a service's JSON answer, checked against the text's tagged tokens.

    No answer gives null, an answer without resources an empty array.
    """
    found = F.from_json(response, RESPONSE_SCHEMA)["Resources"]

    def keep(r: Column, nouns: Column) -> Column:
        start = r["@offset"].cast("int")
        return (
            convincing(r["@similarityScore"].cast("double"), r["@percentageOfSecondRank"].cast("double"))
            & span_has_noun(start, r["@surfaceForm"], nouns)
            & wanted_entity(r["@URI"], r["@surfaceForm"])
        )

    def shape(r: Column) -> Column:
        return F.struct(
            r["@surfaceForm"].alias("surface"),
            r["@offset"].cast("int").alias("start"),
            annotation_kind(r["@types"]).alias("kind"),
            r["@URI"].alias("uri"),
        )

    none = F.expr(f"CAST(array() AS array<{ANNOTATION_SCHEMA}>)")
    # one element, so that the nouns are taken once and not for every resource
    texts = F.array(F.struct(found.alias("found"), noun_begins(tagged).alias("nouns")))
    kept = F.transform(texts, lambda t: F.transform(F.filter(t["found"], lambda r: keep(r, t["nouns"])), shape))[0]
    return F.when(response.isNull(), None).otherwise(F.coalesce(kept, none))


def annotation_uris(annotations: Column) -> Column:
    return F.transform(annotations, lambda a: a["uri"])


def to_document(annotations: Column) -> Column:
    """Annotations as a JSON text."""
    return F.to_json(annotations)


def from_document(document: Column) -> Column:
    """Annotations from their JSON text; an unknown kind is an error."""
    annotations = F.from_json(document, f"array<{ANNOTATION_SCHEMA}>")
    known = F.forall(annotations, lambda a: a["kind"].isin(KINDS))
    return F.when(F.coalesce(known, F.lit(True)), annotations).otherwise(
        F.raise_error(F.concat(F.lit("unknown annotation kind in "), document))
    )

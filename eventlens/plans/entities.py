"""Queries over annotations, resources and their similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import similarity as S
from ..functions.text import pinned
from ..operators import annotate
from ..session import new_path, spread
from ..sources import store
from . import inputs, sql
from .registry import query

ANNOTATED = f"WITH {sql.ENTITIES}"


def _annotated(spark, sf):
    return annotate.annotate(inputs.responses(spark, sf))


@query("annotations_parse", f"""
{ANNOTATED} SELECT id, surface, CAST(start AS INTEGER) AS start, kind, uri FROM annotations
""")
def _annotations_parse(spark, sf):
    return _annotated(spark, sf).select("id", F.inline("annotations"))


@query("annotation_uris", f"""
{ANNOTATED}, found AS (SELECT id, string_agg(uri, ' ' ORDER BY start) AS uris FROM annotations GROUP BY id)
SELECT doc_id AS id, coalesce(uris, '') AS uris
FROM documents LEFT JOIN found ON doc_id = id
""")
def _annotation_uris(spark, sf):
    uris = F.array_join(A.annotation_uris(F.col("annotations")), " ")
    return _annotated(spark, sf).select("id", uris.alias("uris"))


@query("annotation_kind", f"{ANNOTATED} SELECT id, start, kind FROM entities")
def _annotation_kind(spark, sf):
    rows = inputs.responses(spark, sf).select(
        "id", F.explode(F.from_json("response", A.RESPONSE_SCHEMA)["Resources"]).alias("r")
    )
    return rows.select("id", F.col("r.@offset").cast("int").alias("start"),
                       A.annotation_kind(F.col("r.@types")).alias("kind"))


@query("annotation_filter", f"{ANNOTATED} SELECT id, start FROM entities WHERE uri <> '{inputs.URI}Music' AND surface <> 'Day'")
def _annotation_filter(spark, sf):
    rows = inputs.responses(spark, sf).select(
        "id", F.explode(F.from_json("response", A.RESPONSE_SCHEMA)["Resources"]).alias("r")
    )
    kept = rows.filter(A.wanted_entity(F.col("r.@URI"), F.col("r.@surfaceForm")))
    return kept.select("id", F.col("r.@offset").cast("int").alias("start"))


@query("span_has_noun", f"""
{ANNOTATED} SELECT id, start, EXISTS (SELECT 1 FROM tagged t WHERE t.id = e.id AND t.tag LIKE 'N%'
AND t.begin BETWEEN e.start AND e.start + length(e.surface)) AS has_noun FROM entities e
""")
def _span_has_noun(spark, sf):
    found = F.from_json("response", A.RESPONSE_SCHEMA)["Resources"]
    rows = pinned(inputs.responses(spark, sf), found=found, nouns=A.noun_begins(F.col("tagged")))

    def spans(r):
        start = r["@offset"].cast("int")
        noun = A.span_has_noun(start, r["@surfaceForm"], F.col("nouns"))
        return F.struct(start.alias("start"), noun.alias("has_noun"))

    return rows.select("id", F.inline(F.transform("found", spans)))


@query("annotation_roundtrip", f"""
{ANNOTATED} SELECT id, surface, CAST(start AS INTEGER) AS start, kind, uri FROM annotations
""")
def _annotation_roundtrip(spark, sf):
    documents = _annotated(spark, sf).select("id", A.to_document(F.col("annotations")).alias("document"))
    return documents.select("id", F.inline(A.from_document(F.col("document"))))


@query("annotate_collection", f"""
{ANNOTATED}, found AS (SELECT id, count(*) AS n FROM annotations GROUP BY id)
SELECT doc_id AS id, coalesce(n, 0) AS n, (SELECT count(*) FROM documents) AS written
FROM documents LEFT JOIN found ON doc_id = id
""")
def _annotate_collection(spark, sf):
    path = new_path(spark, "annotations")
    written = store.insert_annotations(_annotated(spark, sf).withColumn("seq", F.col("id")), path, "seq")
    rows = spark.read.parquet(path)
    n = F.when(F.col("annotations").isNotNull(), F.size("annotations").cast("bigint"))
    return rows.select("id", n.alias("n"), F.lit(written).cast("bigint").alias("written"))


@query("annotation_upsert", f"""
{ANNOTATED}, found AS (SELECT id, count(*) AS n FROM annotations GROUP BY id),
counted AS (SELECT doc_id AS id, coalesce(n, 0) AS n, lang FROM documents LEFT JOIN found ON doc_id = id)
SELECT id, n, CASE WHEN lang = 'fr' THEN 'first' ELSE 'again' END AS origin FROM counted
""")
def _annotation_upsert(spark, sf):
    """French texts are stored first; then those of every language arrive twice, in two versions."""
    langs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    all_rows = inputs.stored(_annotated(spark, sf).join(langs, "id"))
    path = new_path(spark, "annotations")
    first = all_rows.filter("lang = 'fr'").select("id", "annotations", F.lit("first").alias("origin"))
    store.insert_annotations(first.withColumn("seq", F.col("origin")), path, "seq")
    versions = F.explode(F.array(F.lit("again"), F.lit("later"))).alias("origin")
    batch = all_rows.select("id", "annotations", versions)
    store.insert_annotations(batch.withColumn("seq", F.col("origin")), path, "seq")
    return spark.read.parquet(path).select("id", F.size("annotations").cast("bigint").alias("n"), "origin")


@query("annotation_lookup", f"""
{ANNOTATED}, found AS (SELECT id, count(*) AS n FROM annotations GROUP BY id)
SELECT event_id AS id, doc_id IS NOT NULL AS known, CASE WHEN doc_id IS NOT NULL THEN coalesce(n, 0) END AS n
FROM events LEFT JOIN documents ON doc_id = event_id LEFT JOIN found ON found.id = event_id
""")
def _annotation_lookup(spark, sf):
    ids = inputs.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    rows = store.lookup_annotations(ids, _annotated(spark, sf))
    n = F.when(F.col("annotations").isNotNull(), F.size("annotations").cast("bigint"))
    return rows.select("id", "known", n.alias("n"))


NAMES = f"""
benchmark_words AS (SELECT {sql.kept_words('lower(text)')} AS w FROM benchmark),
names AS (SELECT DISTINCT surface FROM (
  SELECT unnest(w) AS surface FROM benchmark_words UNION ALL
  SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM benchmark_words)),
gazetteer AS (SELECT surface, '{inputs.URI}' || replace(surface, ' ', '_') AS uri, {sql.kind_of('length(surface)')} AS kind
  FROM names WHERE length(surface) % 3 <> 0 AND length(surface) % 4 <> 2 AND upper(surface) NOT IN
  ('SURPRISE', 'YOUTUBE', 'VIMEO', 'TWITTER', 'DAY', 'THURSDAY', 'OURSELVES'))"""


@query("gazetteer_link", f"""
WITH {NAMES},
found AS (SELECT doc_id AS id, list_transform({sql.words('text')}, lambda t: lower(t)) AS w FROM documents),
spans AS (SELECT id, unnest(w) AS surface FROM found UNION ALL
  SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM found)
SELECT id, surface, kind, uri, count(*) AS n FROM spans JOIN gazetteer USING (surface) GROUP BY ALL
""")
def _gazetteer_link(spark, sf):
    texts = spread(inputs.texts(spark, sf))
    found = annotate.link_entities(texts, inputs.gazetteer(spark, sf), max_words=2)
    return found.groupBy("id", "surface", "kind", "uri").agg(F.count(F.lit(1)).alias("n"))


# --- resources ---------------------------------------------------------------------------------

LINKS = "array_to_string(list_sort(list_distinct(in_links)), '+')"


def _links(col):
    return F.array_join(col, "+")


@query("resource_lookup", f"""
WITH {sql.TAGS}
SELECT DISTINCT uri, {LINKS} AS links FROM tags
""")
def _resource_lookup(spark, sf):
    uris = inputs.tag_uris(spark, sf).select(F.explode("uris").alias("uri"))
    found = annotate.find_resources(uris, inputs.page_links(spark, sf))
    return found.select("uri", _links("in_links").alias("links"))


@query("enrich_resources", f"""
WITH {sql.TAGS},
found AS (SELECT id, string_agg(uri || '=' || {LINKS}, ' ' ORDER BY uri) AS resources
          FROM tags GROUP BY id)
SELECT doc_id AS id, coalesce(resources, '') AS resources FROM documents LEFT JOIN found ON id = doc_id
""")
def _enrich_resources(spark, sf):
    rows = annotate.attach_resources(inputs.tag_uris(spark, sf), inputs.page_links(spark, sf))
    shown = F.transform("resources", lambda r: F.concat(r["uri"], F.lit("="), _links(r["in_links"])))
    return rows.select("id", F.array_join(shown, " ").alias("resources"))


@query("resource_similarity", f"""
WITH {sql.PART_RESOURCES}
SELECT a.p_partkey AS id, round(len(list_intersect(a.in_links, b.in_links))
/ len(list_distinct(list_concat(a.in_links, b.in_links))), 6) AS links, 1.0 AS any_pair
FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey + 1
""")
def _resource_similarity(spark, sf):
    parts = inputs.part_resources(spark, sf).select(
        F.col("p_partkey").alias("id"), F.struct("uri", "in_links").alias("a")
    )
    after = parts.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return parts.join(after, "id").select(
        "id", F.round(S.shared_links(a, b), 6).alias("links"), S.any_resource(a, b).alias("any_pair")
    )


SETS = f"""
WITH {sql.TAGS},
members AS (SELECT id, length(word) <= 9 AS back, uri, in_links FROM tags),
sizes AS (SELECT doc_id AS id, count(uri) FILTER (back) AS n, count(uri) FILTER (NOT back) AS m
          FROM documents LEFT JOIN members ON id = doc_id GROUP BY doc_id),
pairs AS (SELECT a.id, a.uri AS a, b.uri AS b, len(list_intersect(a.in_links, b.in_links))
  / len(list_distinct(list_concat(a.in_links, b.in_links))) AS sim
  FROM members a JOIN members b ON a.id = b.id AND a.back AND NOT b.back),
forth AS (SELECT id, avg(best) AS mean, max(best) AS top FROM (SELECT id, a, max(sim) AS best FROM pairs GROUP BY id, a) GROUP BY id),
back AS (SELECT id, avg(best) AS mean FROM (SELECT id, b, max(sim) AS best FROM pairs GROUP BY id, b) GROUP BY id),
sims AS (SELECT id, n, m, CASE WHEN n < m THEN f.mean WHEN n > m THEN b.mean ELSE (f.mean + b.mean) / 2 END AS sim, top
  FROM sizes LEFT JOIN forth f USING (id) LEFT JOIN back b USING (id))"""


@query("set_similarity", f"""
{SETS} SELECT id, round(CASE WHEN n > 0 AND m > 0 THEN sim END, 6) AS similarity FROM sims
""")
def _set_similarity(spark, sf):
    sim = S.set_similarity(F.col("left"), F.col("right"), S.shared_links)
    return inputs.tag_sets(spark, sf).select("id", F.round(sim, 6).alias("similarity"))


@query("set_similarity_max", f"{SETS} SELECT id, round(coalesce(top, 0), 6) AS similarity FROM sims")
def _set_similarity_max(spark, sf):
    sim = S.set_similarity_max(F.col("left"), F.col("right"), S.shared_links)
    return inputs.tag_sets(spark, sf).select("id", F.round(sim, 6).alias("similarity"))


@query("semantic_similarity", f"""
{SETS} SELECT id, round(CASE WHEN n > 0 AND m > 0 THEN sim ELSE 1 END, 6) AS by_links, 1.0 AS by_default FROM sims
""")
def _semantic_similarity(spark, sf):
    left, right = F.col("left"), F.col("right")
    return inputs.tag_sets(spark, sf).select(
        "id",
        F.round(S.semantic_similarity(left, right, S.shared_links), 6).alias("by_links"),
        S.semantic_similarity(left, right).alias("by_default"),
    )


@query("time_similarity", """
SELECT a.event_id AS id, round(1 - least(abs(epoch_us(b.ts) / 3.6e9 - epoch_us(a.ts) / 3.6e9) / 72, 1), 6) AS similarity,
       1.0 AS undecayed
FROM events a JOIN events b ON b.event_id = coalesce(nullif(a.event_id, (SELECT max(event_id) FROM events)) + 1, (SELECT min(event_id) FROM events))
""")
def _time_similarity(spark, sf):
    events = inputs.table(spark, sf, "events").select(F.col("event_id").alias("id"), S.hours(F.col("ts")).alias("h"))
    ends = events.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    # each event with the one before it by number, the first with the last
    before = F.when(F.col("id") == ends["low"], F.lit(ends["high"])).otherwise(F.col("id") - 1)
    other = events.select(before.alias("id"), F.col("h").alias("g"))
    apart = F.col("g") - F.col("h")
    return events.join(other, "id").select(
        "id",
        F.round(S.time_similarity(apart), 6).alias("similarity"),
        S.time_similarity(apart, "off").alias("undecayed"),
    )

import json
import random

import pytest
from pyspark.sql import functions as F

from eventlens.functions import annotations as A
from eventlens.operators import annotate
from eventlens.session import new_path
from eventlens.sources import store

TAGGED = "array<struct<begin int, end int, word string, tag string, lemma string>>"
ANNOTATED = "id bigint, annotations array<struct<surface string, start int, kind string, uri string>>"


def resource(surface, offset, score="0.9", second="0.1", uri="http://x/Rome", types="DBpedia:Place"):
    return {"@surfaceForm": surface, "@URI": uri, "@offset": str(offset), "@similarityScore": score,
            "@percentageOfSecondRank": second, "@types": types}


# "in Rome now with you"
TAGS = [(0, 2, "in", "IN", None), (3, 7, "Rome", "NNP", None), (8, 11, "now", "RB", None),
        (12, 16, "with", "IN", None), (17, 20, "you", "PRP", None)]


def parse(spark, response):
    text = None if response is None else json.dumps(response)
    df = spark.createDataFrame([(1, text, TAGS)], f"id bigint, response string, tagged {TAGGED}")
    found = annotate.annotate(df).first()["annotations"]
    return None if found is None else [tuple(a) for a in found]


@pytest.mark.parametrize(
    "change,kept",
    [
        ({}, True),
        ({"score": "0.8"}, False),
        ({"score": "0.81"}, True),
        ({"second": "0.5"}, True),
        ({"second": "0.51"}, False),
        ({"uri": "http://dbpedia.org/resource/Music"}, False),
        ({"surface": "twitter"}, False),
        ({"surface": "now", "offset": 8}, False),
        ({"surface": "in", "offset": 1}, True),  # the noun begins where the span ends
    ],
)
def test_acceptance(spark, change, kept):
    r = resource(**{"surface": "Rome", "offset": 3, **change})
    got = parse(spark, {"Resources": [r]})
    assert len(got) == (1 if kept else 0)


@pytest.mark.parametrize("nouns", [[], [5], [3, 3, 9], [0, 4, 8, 15, 16, 23, 42], list(range(0, 64, 3))])
def test_first_noun_is_searched(spark, nouns):
    """Unsorted tokens, spans before, among and behind the nouns, and what is null."""
    tagged = [(b, b + 1, "w", "NN", None) for b in reversed(nouns)] + [(7, 8, "w", "VB", None), (None, 8, "w", "NN", None)]
    spans = [(start, "x" * n) for start in (-2, 0, 1, 3, 6, 9, 17, 41, 43, 70) for n in (0, 1, 4)]
    rows = spark.createDataFrame([(tagged, spans)], f"tagged {TAGGED}, spans array<struct<start int, surface string>>")
    held = rows.select("spans", A.noun_begins(F.col("tagged")).alias("nouns"))
    got = held.select(F.transform("spans", lambda s: A.span_has_noun(s["start"], s["surface"], F.col("nouns")))).first()[0]
    assert got == [any(start <= b <= start + len(text) for b in nouns) for start, text in spans]
    none = held.select(A.span_has_noun(F.lit(None).cast("int"), F.lit("x"), F.col("nouns"))).first()[0]
    assert none is (None if nouns else False)


def test_tagged_text_is_not_copied_to_every_entity(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["span_has_noun"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("Aggregate")]
    assert "exists(" not in top and "explode(" not in top


def test_answers_without_resources(spark):
    assert parse(spark, {}) == []
    assert parse(spark, None) is None
    assert parse(spark, {"Resources": [resource("Rome", 3)]}) == [("Rome", 3, "Where", "http://x/Rome")]


@pytest.mark.parametrize(
    "types,kind",
    [("DBpedia:Person,DBpedia:Place", "Where"), ("DBpedia:Organisation", "Who"), ("DBpedia:Person", "Who"),
     ("DBpedia:Time", "When"), ("Schema:Place", "What"), ("", "What"), (None, "What")],
)
def test_kinds(spark, types, kind):
    df = spark.createDataFrame([(types,)], "t string")
    assert df.select(A.annotation_kind(F.col("t")).alias("k")).first()["k"] == kind


def test_documents(spark):
    rows = [(1, [("Rome", 3, "Where", "u")]), (2, [])]
    df = spark.createDataFrame(rows, ANNOTATED)
    again = df.select("id", A.from_document(A.to_document(F.col("annotations"))).alias("annotations"))
    assert again.exceptAll(df).count() == 0
    bad = spark.createDataFrame([('[{"kind":"Why"}]',)], "d string").select(A.from_document(F.col("d")))
    with pytest.raises(Exception, match="unknown annotation kind"):
        bad.collect()


def test_first_write_wins(spark):
    path = new_path(spark, "annotations")
    first = spark.createDataFrame([(1, [("a", 0, "What", "u")]), (2, [])], ANNOTATED)
    assert store.insert_annotations(first.withColumn("seq", F.lit(0)), path, "seq") == 2
    second = spark.createDataFrame([(1, []), (3, []), (3, [("late", 0, "What", "u")])], ANNOTATED)
    second = second.withColumn("seq", F.size("annotations"))
    assert store.insert_annotations(second, path, "seq") == 1
    stored = spark.read.parquet(path)
    assert {r["id"]: len(r["annotations"]) for r in stored.collect()} == {1: 1, 2: 0, 3: 0}
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id bigint")
    got = {r["id"]: (r["known"], r["annotations"]) for r in store.lookup_annotations(ids, stored).collect()}
    assert got[9] == (False, None) and got[2] == (True, []) and got[1][0]


def test_resources(spark):
    uris = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["zz"]), (3, [])], "id bigint, uris array<string>")
    links = spark.createDataFrame([("a", ["y", "x", "y"]), ("b", [])], "uri string, in_links array<string>")
    got = {r["id"]: [tuple(x) for x in r["resources"]] for r in annotate.attach_resources(uris, links).collect()}
    assert got == {1: [("a", ["x", "y"]), ("b", [])], 2: [], 3: []}


def test_gazetteer(spark):
    texts = spark.createDataFrame([(1, "In New York, new york City"), (2, None)], "id bigint, text string")
    names = [("new york", "u1", "DBpedia:Place", 0.9, 0.1), ("new york city", "u2", "", 0.9, 0.1),
             ("in", "u3", "", 0.5, 0.1), ("city", "u4", "", 0.9, 0.9)]
    gazetteer = spark.createDataFrame(names, "surface string, uri string, types string, score double, second_rank double")
    got = {(r["start"], r["uri"]) for r in annotate.link_entities(texts, gazetteer).collect()}
    assert got == {(3, "u1"), (13, "u1"), (13, "u2")}


@pytest.mark.parametrize("bits", [64, annotate.FILTER_BITS])
def test_gazetteer_equals_brute_force(spark, monkeypatch, bits):
    """A filter too small to keep anything back gives the same links as the large one."""
    monkeypatch.setattr(annotate, "FILTER_BITS", bits)
    rnd = random.Random(6)
    words = ["Rome", "new", "york", "City", "of", "light", "x", "ÉTÉ"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 40, 90]))) for _ in range(40)]
    names = {" ".join(rnd.choice(words).lower() for _ in range(rnd.randint(1, 4))) for _ in range(30)}
    rows = [(n, f"u{k}", "", 0.9, 0.1) for n in sorted(names) for k in range(1 + len(n) % 2)] + [(None, "u", "", 0.9, 0.1)]
    want = []
    for i, text in enumerate(texts):
        own, at = text.lower().split(), 0
        for k, word in enumerate(own):
            spans = [" ".join(own[k : k + n]) for n in (1, 2, 3) if k + n <= len(own)]
            want += [(i, s, at, u) for s in spans for n, u, *_ in rows if n == s]
            at += len(word) + 1
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id bigint, text string")
    gazetteer = spark.createDataFrame(rows, "surface string, uri string, types string, score double, second_rank double")
    got = annotate.link_entities(df, gazetteer).select("id", "surface", "start", "uri").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_queries_and_sql_go_together():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "event_clusters" in entry.queries() and len(entry.queries()) > 100


def test_upsert_query_stores_every_language(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = {r["id"]: r["origin"] for r in entry.queries()["annotation_upsert"](spark, sf).collect()}
    assert found == {i: "first" if lang == "fr" else "again" for i, lang in langs.items()}

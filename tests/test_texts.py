import re
import random

import pytest
from pyspark.sql import functions as F

from eventlens.functions import text as X
from eventlens.functions import words as W
from eventlens.operators import features as V
from eventlens.operators import series
from eventlens.session import new_path
from eventlens.sources import files, tweets

from .brute import cosine, tfidf


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("can't 3,000 wi-fi 2012", ["can't", "3,000", "wi", "fi", "2012"]),
        ("end.2012 U.S.A. v2.0 a_b 10:30", ["end", "2012", "U.S.A", "v2.0", "a_b", "10", "30"]),
        ("x" * 51 + " ok", ["ok"]),
        (None, []),
    ],
)
def test_split_words(spark, text, want):
    assert one(spark, text, X.split_words) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("can't 3,000 wi-fi 2012", ["can", "t", "wi", "fi", "2012"]),
        ("end.2012 v2.0 a_b 2012_x 1a.b _7 10:30", ["end", "2012", "v2", "a", "b", "x", "b", "10", "30"]),
        ("a." * 30 + "z plain", ["plain"]),
    ],
)
def test_subwords_in_one_pass(spark, text, want):
    assert one(spark, text, lambda c: X.split_subwords(X.split_words(c))) == want
    assert one(spark, text, X.subwords) == want


def test_tokenize(spark):
    text = "TWITTER FLASHMOB: Favorite the tweet but don't RT! Ponies, houses, buses and the glass 2012"
    assert one(spark, text, X.tokenize) == ["flashmob", "don", "pony", "house", "buse", "glass", "2012"]
    assert "ponies" in one(spark, text, lambda c: X.tokenize(c, stem="none"))
    assert one(spark, None, X.tokenize) == []


def test_stop_lists():
    custom = W.CUSTOM_STOP_WORDS
    assert "ours " in custom and "ours" not in custom
    assert {"can't", "cant", "arent", "youre", "rt"} <= set(custom)
    assert not {"aren't", "hed", "well", "flash"} & set(custom)
    assert "flashmob" in W.stop_words(flash_mob=True)


def test_stop_words_keep_repeats(spark):
    assert one(spark, "The big Big the", lambda c: X.drop_stop_words(F.split(c, " "))) == ["big", "Big"]


def test_elongations(spark):
    text = "hahahaha looool 1999 3000"
    assert one(spark, text, X.without_elongations) == "  l l 1999 3000"
    assert one(spark, "hahahaha looool 3000", X.elongations) == ["hahahaha", "oooo"]
    tale = "ballare ammazzzare loooool ????? RonRonRon BobRonJoe"
    want = [m.group(0) for m in re.finditer(r"([a-zA-Z]+)\1{2,}", tale)]
    assert one(spark, tale, X.elongations) == want


def test_camel_case(spark):
    tag = "HappyBirthdayTomHiddleston2012"
    assert one(spark, tag, X.split_camel) == ["Happy", "Birthday", "Tom", "Hiddleston2012"]
    assert one(spark, tag, lambda c: X.split_camel(c, digits=True)) == ["Happy", "Birthday", "Tom", "Hiddleston", "2012"]


def test_emoticons(spark):
    found = one(spark, "nice :) <3 sad :( and :-) x:Dy", X.emoticons)
    assert (found["smileys"], found["frownies"]) == (4, 1)
    assert found["emoticons"] == 4


def test_remove_accents(spark):
    assert one(spark, "éçøñ Ünïcode", X.remove_accents) == "ecøn Unicode"
    assert one(spark, None, X.remove_accents) is None


def test_boost(spark):
    df = spark.createDataFrame([("hi", None, ["A", "B"]), ("yo", "a b", [])], "t string, s string, h array<string>")
    rows = df.select(X.boosted_text(F.col("t"), F.col("s"), F.col("h")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["hi  A B", "yo a b "]


def test_offsets(spark):
    text = "don't stop, 3,000 — été!"
    df = spark.createDataFrame([(1, text), (2, None)], "id bigint, text string")
    rows = X.token_offsets(df, "id", "text").orderBy("start").collect()
    assert [r["token"] for r in rows] == ["don't", "stop", "3,000", "été"]
    assert all(text[r["start"]:r["end"]] == r["token"] for r in rows)


def test_offsets_of_long_texts(spark):
    """Texts of more words than a block, and than a block of blocks, hold, with letters that change when lowered."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "Été", "İx", "don't", "3,1"]) + rnd.choice([" ", ", ", "\n\n", " 😀 "]) for _ in range(n))
             for n in (0, 1, 31, 32, 33, 64, 1023, 1024, 1025, 2500)]
    df = spark.createDataFrame(list(enumerate(["", None, " . ", *texts])), "id bigint, text string")
    held = dict(df.collect())
    rows = X.token_offsets(df, "id", "text").collect()
    assert all(held[r["id"]][r["start"]:r["end"]] == r["token"] for r in rows)
    places = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["pos"])):
        places.setdefault(r["id"], []).append(r["start"])
    assert all(starts == sorted(set(starts)) for starts in places.values())
    assert [len(places.get(i, [])) for i in range(13)] == [0, 0, 0, 0, 1, 31, 32, 33, 64, 1023, 1024, 1025, 2500]


TAGGED = "array<struct<begin int, end int, word string, tag string, lemma string>>"


def test_tagged_words(spark):
    words = [
        (0, 4, "Dogs", "NNS", "dog"), (5, 7, "is", "VBZ", "be"), (8, 14, "sooooo", "RB", "sooooo"),
        (15, 18, "you", "PRP", "you"), (19, 23, "Rome", "NNP", None), (24, 29, "Wi-Fi", "NN", "Wi-Fi"),
        (30, 35, "flash", "NN", "flash"),
    ]
    df = spark.createDataFrame([(words,)], f"t {TAGGED}")
    kept = df.select(X.keep_content_words(F.col("t")).alias("r")).first()["r"]
    assert [t["word"] for t in kept] == ["Dogs", "Rome", "Wi-Fi", "flash"]
    pairs = df.select(X.lemma_tags(F.col("t")).alias("r")).first()["r"]
    assert [tuple(p) for p in pairs] == [("dog", "NNS"), ("rome", "NNP"), ("wi-fi", "NN")]
    parts = df.select(X.lemma_tags(F.col("t"), split_parts=True, flash_mob=False).alias("r")).first()["r"]
    assert [p["lemma"] for p in parts] == ["dog", "Rome", "Wi", "Fi", "flash"]
    weights = df.select(F.transform("t", lambda t: X.proper_noun_weight(t["word"], t["tag"])).alias("r")).first()["r"]
    assert weights == [1.0, 1.0, 1.0, 1.0, 1.5, 1.0, 1.0]
    lemmas = spark.createDataFrame([(["Be", "House", "a1b", "été"],)], "l array<string>")
    assert lemmas.select(X.clean_lemmas(F.col("l")).alias("r")).first()["r"] == ["house", "été"]


def write_lines(spark, lines):
    path = new_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_dictionary_and_normalisation(spark):
    path = write_lines(spark, ["abt\tabout", "im\ti'm", "bcoz because", "im\tI am", "B4\tbefore"])
    entries, rejects = files.read_dictionary(spark, path)
    assert {r["token"]: r["replacement"] for r in entries.collect()} == {
        "abt": "about", "im": "I am", "B4": "before"}
    assert [r["value"] for r in rejects.collect()] == ["bcoz because"]
    df = spark.createDataFrame([(1, "im abt  b4 B4"), (2, "none")], "id bigint, text string")
    rows = X.normalize_words(df, "id", "text", entries).orderBy("id").collect()
    assert [r["normalized"] for r in rows] == ["I am about  b4 before", "none"]
    for small in (0, 1000):
        many = [(i, "im abt  b4 B4", None)[:2] for i in range(3000)] + [(3000, "none"), (3001, None), (3002, ""), (3003, "abt abt")]
        df = spark.createDataFrame(many, "id bigint, text string").repartition(3)
        got = {r["id"]: r["normalized"] for r in X.normalize_words(df, "id", "text", entries, small).collect()}
        want = {i: "I am about  b4 before" for i in range(3000)}
        assert got == want | {3000: "none", 3001: None, 3002: "", 3003: "about about"}


def test_line_readers(spark):
    rows = files.read_id_text(spark, write_lines(spark, ["1\tone\tmore", "no text", "3\t"])).collect()
    assert [tuple(r) for r in rows] == [(1, "one"), (3, "")]
    points = files.read_points(spark, write_lines(spark, ["1\t15.55\t28.65\t2\r", "2\t14.9\t27.55\t2\r"]))
    assert [tuple(r) for r in points.orderBy("id").collect()] == [(1, 15.55, 28.65), (2, 14.9, 27.55)]


def test_windows_and_lookup(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=h)) for i, h in enumerate([0, 1, 71.9, 72, 80])]
    df = spark.createDataFrame(rows, "id bigint, created_at timestamp")
    assert [r["id"] for r in tweets.from_offset(df, start, 72).collect()] == [0, 1, 2]
    assert tweets.earliest(df).first()["min_date"] == start
    ids = spark.createDataFrame([(1,), (9,), (1,)], "id bigint")
    assert [r["id"] for r in tweets.lookup(df, ids).collect()] == [1]


def rows_of(spark, tokens):
    return spark.createDataFrame(list(tokens.items()), "id bigint, tokens array<string>")


@pytest.mark.parametrize("heavy_rows", [1_000_000, 1])
def test_tfidf(spark, heavy_rows):
    tokens = {1: ["a", "b", "b"], 2: ["a", "c"], 3: ["a", "b"], 4: ["d", "c", "c", "e"]}
    vectors = V.tfidf(V.term_freq(rows_of(spark, tokens)), heavy_rows=heavy_rows)
    got = {}
    for r in vectors.collect():
        got.setdefault(r["id"], {})[r["term"]] = r["w"]
    want = tfidf(tokens)
    assert got.keys() == {i for i, v in want.items() if v}
    for i, vector in got.items():
        assert vector == pytest.approx(want[i])


def test_idf_of_a_term_in_every_document(spark):
    tokens = {1: ["a", "b"], 2: ["a", "c"], 3: ["a", "b"]}
    idf = V.inverse_doc_freq(V.doc_freq(V.term_freq(rows_of(spark, tokens))))
    got = {r["term"]: round(r["idf"], 8) for r in idf.collect()}
    assert got == {"a": 0.0, "b": 0.28768207, "c": 0.0}


def test_copies_count_as_documents(spark):
    tokens = {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "c"], 4: ["c", "d"]}
    whole = {r["term"]: r["idf"] for r in V.inverse_doc_freq(V.doc_freq(V.term_freq(rows_of(spark, tokens)))).collect()}
    rows = spark.createDataFrame([(1, 2, ["a", "b"]), (3, 1, ["a", "c"]), (4, 1, ["c", "d"])], "id bigint, copies bigint, tokens array<string>")
    tf = V.term_freq(rows, "copies")
    assert {r["term"]: r["idf"] for r in V.inverse_doc_freq(V.doc_freq(tf, "copies")).collect()} == whole


def test_map_vectors(spark):
    a = {"a": 0.9, "b": 0.3, "c": 0.4, "d": 0.2, "e": 0.2}
    cases = [(a, a), (a, {"x": 1.0}), (a, {}), ({"a": 0.0}, {"a": 0.0}), (a, {"a": 2.0, "d": 1.0})]
    df = spark.createDataFrame(cases, "u map<string,double>, v map<string,double>")
    got = [r["r"] for r in df.select(V.packed_cosine(F.col("u"), F.col("v")).alias("r")).collect()]
    assert got == pytest.approx([cosine(u, v) for u, v in cases])
    long = spark.createDataFrame([(1, t, w) for t, w in a.items()], "id bigint, term string, w double")
    assert [r["term"] for r in V.top_terms(long, 4).orderBy("rank").collect()] == ["a", "c", "b", "d"]


def test_vector_average(spark):
    rows = [(1, "p", 0.4), (1, "q", 0.2), (2, "p", 0.6), (2, "r", 0.5)]
    df = spark.createDataFrame(rows, "id bigint, term string, w double").withColumn("g", F.lit(0))
    got = {r["term"]: r["w"] for r in V.average_vectors(df, "g").collect()}
    assert got == pytest.approx({"p": 0.5, "q": 0.2, "r": 0.5})


def test_series(spark):
    values = [0.1, 0.1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
    long = [float((i * 37) % 11) for i in range(3000)]
    rows = [("s", i, v) for i, v in enumerate(values)] + [("one", 0, 4.0)] + [("long", i, v) for i, v in enumerate(long)]
    df = spark.createDataFrame(rows, "k string, ts int, v double")
    got = {r["k"]: r["ema"] for r in series.moving_average(df, "k", ["ts"], "v").collect()}
    state = long[0]
    for v in long[1:]:
        state = 0.5 * v + 0.5 * state
    assert got == pytest.approx({"s": 0.503125, "one": 4.0, "long": state})
    assert {r["k"]: r["mean"] for r in series.series_mean(df.filter("k = 's'"), "k", "v").collect()} == pytest.approx({"s": 0.2875})


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("same"))
    got = series.number_rows(df, [F.col("same"), F.col("v")])
    assert got.filter("number <> v").count() == 0 and got.count() == 1000


def test_stem_by_table(spark):
    rows = [(1, ["running", "ran", "running", "cat"]), (2, []), (3, None), (None, ["ran", None])]
    docs = spark.createDataFrame(rows, "doc long, words array<string>")
    stems = spark.createDataFrame([("running", "run"), ("ran", "run"), ("ran", "rune"), ("dog", "d")], "surface string, stem string")
    found = {r["id"]: r["tokens"] for r in X.stem_by_table(docs, "doc", "words", stems).collect()}
    assert found == {1: ["run", "run", "run", "cat"], 2: [], 3: [], None: ["run", None]}


def test_stem_by_vocabulary(spark):
    forms = {
        "cities": "city", "carried": "carry", "boxes": "box", "cats": "cat", "falling": "fall", "stopping": "stop",
        "planned": "plan", "making": "make", "used": "use", "walked": "walk", "buildings": "building", "building": "build",
    }
    kept = ["thing", "red", "boss", "virus", "news", "sing", "dries", "string", "ing", "s", ""]  # no word of theirs is a term
    texts = [sorted(forms), sorted(set(forms.values())), kept, None, [], ["cats", "cat", "cats"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, words array<string>").repartition(3)
    got = {r["id"]: r["tokens"] for r in X.stem_by_vocabulary(df, "doc", "words").collect()}
    want = [forms.get(t, t) for t in sorted(set(forms.values()))]
    assert got == {0: [forms[t] for t in sorted(forms)], 1: want, 2: kept, 3: [], 4: [], 5: ["cat"] * 3}
    assert X.stem_by_vocabulary(df.limit(0), "doc", "words").count() == 0
    table = {r["surface"]: r["stem"] for r in X.vocabulary_stems(df.select(F.explode("words").alias("token"))).collect()}
    assert table == forms


def test_words_are_held_by_parts_of_a_text(spark, monkeypatch):
    text = "ab 𝒳yz " + "w" * 1300 + " don't " + "é" * 511 + " end"
    for part in (512, 3):
        monkeypatch.setattr(X, "PART", part)
        df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
        rows = X.offset_words(df, "id", "text").join(df.select("id", X.text_parts(F.col("text")).alias("parts")), "id")
        held = F.transform("words", lambda w: F.struct(w["token"], X.held(F.col("parts"), w["start"], w["end"] - w["start"])))
        got = {r["id"]: [tuple(p) for p in r["w"]] for r in rows.select("id", held.alias("w")).collect()}
        assert got[2] == [] and got[3] == [] and len(got[1]) == 6 and all(a == b for a, b in got[1])


def test_long_runs_are_looked_for_between_blanks_only(spark):
    texts = ["a" * 51, "x " * 60, "b" * 50 + "\n" + "c" * 60 + " d", "é.b" * 30, "", "a" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(X._has_long_run(F.col("t")).alias("got"), F.col("t").rlike(X.LONG_RUN).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and sum(r["got"] for r in rows) == 3


def test_words_are_replaced_by_a_dictionary(spark):
    df = spark.createDataFrame([(1, "a  b c "), (2, None), (3, ""), (4, "z")], "id long, text string")
    words = spark.createDataFrame([("a", "x"), ("c", "é"), ("", "-")], "token string, replacement string")
    for small in (0, 10):
        out = X.normalize_words(df, "id", "text", words, small)
        assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["normalized"] for r in out.collect()}
        assert got == {1: "x - b é -", 2: None, 3: "-", 4: "z"}

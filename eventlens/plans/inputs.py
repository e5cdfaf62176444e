"""The library's inputs, derived from the given tables with Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import boosted_text, split_words, tokenize
from ..operators import features as V
from ..session import cut

URI = "http://dbpedia.org/resource/"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, text)`` of all documents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def hashtags(text: Column) -> Column:
    """Long capitalised words stand in for hashtags."""
    return F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w.rlike("^[A-Z][a-z]{7,}$"))


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dated by the event with their number."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    rows = docs.join(events, "id").withColumn("hashtags", hashtags(F.col("text")))
    joined = F.lower(F.array_join("hashtags", " "))
    return rows.withColumn("split_hashtags", F.when(F.col("lang") == "en", joined))


def raw_tweets(spark: SparkSession, sf: str) -> DataFrame:
    """Tweets as the nested documents they are read from."""
    tags = F.transform(
        "hashtags",
        lambda h: F.struct(h.alias("text"), F.array(F.lit(0), F.length(h)).alias("indices")),
    )
    return tweets(spark, sf).select(
        F.col("id").alias("_id"),
        F.col("text").alias("cleaned_text"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        F.struct(tags.alias("hashtags")).alias("entities"),
        F.col("split_hashtags").alias("splitted_hashtags"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as points: hours since the first event, and value."""
    events = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = events.agg(F.min(micros)).scalar()
    return events.select(
        F.col("event_id").alias("id"),
        ((micros - first) / F.lit(S.MICROS_PER_HOUR)).alias("x"),
        F.col("value").alias("y"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF vectors of the documents."""
    return V.text_vectors(texts(spark, sf), "id", tokenize(F.col("text")))


def boosted_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF vectors of tweets with their hashtags once more."""
    text = boosted_text(F.col("text"), F.col("split_hashtags"), F.col("hashtags"))
    return V.text_vectors(tweets(spark, sf), "id", tokenize(text))


def dense_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings in long form, their dimensions as terms; every dimension is used alike."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.posexplode("embedding").alias("dim", "w")
    )
    return rows.select("id", F.col("dim").cast("string").alias("term"), F.col("w").cast("double").alias("w"))


def tagged_words(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, begin, end, word, tag, lemma)``: blank-separated words with made-up tags and lemmas
    that follow from a word's form."""
    rows = texts(spark, sf).select("id", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    order = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("word")
    tag = (
        F.when(F.col("word").rlike("^[A-Z][a-z]+$") & (n % 7 == 0), "JJ")
        .when(F.col("word").rlike("^[A-Z][a-z]+$") & (n % 2 == 0), "NNP")
        .when(F.col("word").rlike("^[A-Z][a-z]+$"), "NNS")
        .when(F.col("word").rlike("^[a-z]+$") & (n % 3 == 0), "NN")
        .when(F.col("word").rlike("^[a-z]+$") & (n % 3 == 1), "VB")
        .when(F.col("word").rlike("^[a-z]+$"), "PRP")
        .otherwise("SYM")
    )
    lemma = F.when(n % 4 != 0, F.lower("word"))
    end = F.sum(n + 1).over(order) - 1
    return rows.select("id", "pos", (end - n).cast("int").alias("begin"), end.cast("int").alias("end"),
                       "word", tag.alias("tag"), lemma.alias("lemma"))


def tagged_texts(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, tagged)``: the tagged words of each text, in order."""
    token = F.struct("begin", "end", "word", "tag", "lemma")
    return tagged_words(spark, sf).groupBy("id").agg(F.array_sort(F.collect_list(token)).alias("tagged"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, response, tagged)``: what an entity-linking service might answer. Capitalised words
    are the entities; scores, ranks and types follow from a word's length and place."""
    token = F.struct("begin", "end", "word", "tag", "lemma")
    n, begin = F.length("word"), F.col("begin")
    resource = F.when(
        F.col("word").rlike("^[A-Z][a-z]{5,}$"),
        F.struct(
            begin.alias("at"),
            F.struct(
                F.when(n == 10, "Day").otherwise(F.col("word")).alias("@surfaceForm"),
                F.concat(F.lit(URI), F.when(n == 9, "Music").otherwise(F.col("word"))).alias("@URI"),
                begin.cast("string").alias("@offset"),
                F.when(n % 3 == 0, "0.8").when(n % 3 == 1, "0.81").otherwise("0.95").alias("@similarityScore"),
                F.when(begin % 4 == 0, "0.0").when(begin % 4 == 1, "0.5").when(begin % 4 == 2, "0.51")
                .otherwise("0.2").alias("@percentageOfSecondRank"),
                entity_types(n).alias("@types"),
            ).alias("r"),
        ),
    )
    rows = tagged_words(spark, sf).groupBy("id").agg(
        F.array_sort(F.collect_list(token)).alias("tagged"),
        F.array_sort(F.collect_list(resource)).alias("found"),
    )
    answer = F.to_json(F.struct(F.transform("found", lambda f: f["r"]).alias("Resources")))
    return rows.select("id", answer.alias("response"), "tagged")


def entity_types(n: Column) -> Column:
    return (
        F.when(n % 5 == 0, "")
        .when(n % 5 == 1, "Schema:Place,DBpedia:Place,DBpedia:Person")
        .when(n % 5 == 2, "DBpedia:Agent,DBpedia:Person")
        .when(n % 5 == 3, "DBpedia:Time")
        .otherwise("Freebase:/sports")
    )


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Words and word pairs of the benchmark texts as names of entities."""
    items = table(spark, sf, "benchmark")
    words = split_words(F.lower("text"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
        lambda i: F.array_join(F.slice("w", i, 2), " "),
    )
    names = items.select(words.alias("w")).select(F.explode(F.concat(F.col("w"), pairs)).alias("surface"))
    n = F.length("surface")
    return names.distinct().select(
        "surface",
        F.concat(F.lit(URI), F.replace(F.col("surface"), F.lit(" "), F.lit("_"))).alias("uri"),
        entity_types(n).alias("types"),
        F.when(n % 3 == 0, 0.8).otherwise(0.9).alias("score"),
        F.when(n % 4 == 2, 0.51).otherwise(0.5).alias("second_rank"),
    )


def part_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as knowledge-base pages, linked from the words of their names and their brand."""
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit(URI), F.col("p_partkey").cast("string")).alias("uri"),
        F.concat(F.split("p_name", " "), F.array("p_brand")).alias("in_links"),
    )


def tag_resource(word: Column) -> Column:
    """A hashtag as a knowledge-base page, linked from the pieces of its first letters."""
    pieces = F.array(*[F.substring(word, i, 2) for i in (1, 3, 5)])
    return F.struct(F.concat(F.lit(URI), word).alias("uri"), pieces.alias("in_links"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of all hashtags; links repeat."""
    words = texts(spark, sf).select(F.explode(hashtags(F.col("text"))).alias("word")).distinct()
    page = tag_resource(F.col("word"))
    rows = words.select(page.alias("page"))
    return rows.select("page.uri", F.concat("page.in_links", "page.in_links").alias("in_links"))


def tag_uris(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, uris)``: the pages a document's hashtags name, with repeats."""
    uris = F.transform(hashtags(F.col("text")), lambda w: F.concat(F.lit(URI), w))
    return texts(spark, sf).select("id", uris.alias("uris"))


def tag_sets(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, left, right)``: a document's shorter and longer hashtags as resources."""
    words = F.array_distinct(hashtags(F.col("text")))
    short = F.filter(words, lambda w: F.length(w) <= 9)
    long = F.filter(words, lambda w: F.length(w) > 9)
    return texts(spark, sf).select(
        "id", F.transform(short, tag_resource).alias("left"), F.transform(long, tag_resource).alias("right")
    )


def stored(df: DataFrame) -> DataFrame:
    """A derived input as a written table, like the ones the library reads in use."""
    return cut(df, "input")

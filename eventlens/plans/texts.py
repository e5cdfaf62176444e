"""Queries over texts: reading, tokens, normalisation, vectors, series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..operators import features as V
from ..operators import series
from ..session import new_path, spread
from ..sources import files, tweets
from . import inputs, sql
from .registry import query


def _joined(tokens, sep=" "):
    return F.array_join(tokens, sep)


# --- sources -----------------------------------------------------------------------------------


@query("tweets_projection", f"""
WITH {sql.TWEETS}
SELECT id, text, created_at, array_to_string(hashtags, ' ') AS hashtags,
       split_hashtags FROM tweets
""")
def _tweets_projection(spark, sf):
    path = new_path(spark, "raw-tweets")
    inputs.raw_tweets(spark, sf).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    rows = tweets.project_tweets(tweets.read_raw(spark, path))
    return rows.withColumns(
        {"created_at": F.col("created_at").cast("timestamp_ntz"), "hashtags": _joined("hashtags")}
    )


@query("require_field", """
SELECT count(*) AS with_text FROM documents JOIN events ON doc_id = event_id
""")
def _require_field(spark, sf):
    raw = tweets.having_field(inputs.raw_tweets(spark, sf), "cleaned_text")
    return raw.agg(F.count(F.lit(1)).alias("with_text"))


@query("min_date", "SELECT min(ts) AS min_date FROM events")
def _min_date(spark, sf):
    return tweets.earliest(inputs.table(spark, sf, "events"), "ts")


DAY = dt.datetime(2024, 1, 2)


@query("scan_hours_offset", """
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'
""")
def _scan_hours(spark, sf):
    return tweets.from_offset(inputs.table(spark, sf, "events"), DAY, 72, "ts").select("event_id", "ts")


@query("scan_interval", """
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03 12:00:00'
""")
def _scan_interval(spark, sf):
    end = dt.datetime(2024, 1, 3, 12)
    return tweets.in_interval(inputs.table(spark, sf, "events"), DAY, end, "ts").select("event_id", "ts")


@query("lookup_ids", f"""
WITH {sql.TWEETS}
SELECT id, created_at, '' AS hashtags FROM tweets WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def _lookup_ids(spark, sf):
    ids = inputs.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    rows = tweets.lookup(inputs.tweets(spark, sf), ids, tags=False)
    return rows.select("id", "created_at", _joined("hashtags").alias("hashtags"))


@query("take_n", "SELECT doc_id AS id, text FROM documents ORDER BY doc_id LIMIT 100")
def _take_n(spark, sf):
    return tweets.sample(inputs.texts(spark, sf), 100)


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def _row_count(spark, sf):
    return files.row_count(inputs.table(spark, sf, "lineitem"))


@query("read_id_text", """
SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '[\\n\\r\\t]', ' ', 'g') AS text
FROM conversations WHERE role <> 'assistant'
""")
def _read_id_text(spark, sf):
    rows = inputs.table(spark, sf, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    text = F.regexp_replace("text", "[\n\r\t]", " ")
    sep = F.when(F.col("role") == "assistant", " ").otherwise("\t")
    path = new_path(spark, "id-text")
    rows.select(F.concat(key, sep, text)).write.text(path)
    return files.read_id_text(spark, path)  # an assistant's lines have no second field


def _dictionary(spark, sf):
    """A dictionary file from the words of the benchmark texts: each is mapped to its reverse and
    the item it stands in; words with a full stop make lines that are not well-formed."""
    words = inputs.table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(F.split("text", "[ \n]+")).alias("pos", "word")
    )
    value = F.concat(F.reverse("word"), F.col("item_id").cast("string"))
    sep = F.when(F.contains("word", F.lit(".")), " ").otherwise("\t")
    path = new_path(spark, "dictionary")
    rows = words.filter("word <> ''").orderBy("item_id", "pos")
    rows.select(F.concat("word", sep, value)).write.text(path)
    return files.read_dictionary(spark, path)


DICTIONARY = """
entries AS (SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS word
            FROM (SELECT item_id, string_split_regex(text, '[ \\n]+') AS w FROM benchmark)),
dictionary AS (SELECT word AS token, reverse(word) || CAST(max(item_id) AS VARCHAR) AS replacement
               FROM entries WHERE word <> '' AND NOT contains(word, '.') GROUP BY word)"""


@query("oov_load", f"WITH {DICTIONARY} SELECT token, replacement FROM dictionary")
def _oov_load(spark, sf):
    return _dictionary(spark, sf)[0]


@query("oov_rejects", f"""
WITH {DICTIONARY} SELECT word || ' ' || reverse(word) || CAST(item_id AS VARCHAR) AS value
FROM entries WHERE contains(word, '.')
""")
def _oov_rejects(spark, sf):
    return _dictionary(spark, sf)[1]


NORMALIZED = f"""
WITH {DICTIONARY},
split AS (SELECT doc_id, text, unnest(range(len(w))) AS pos, unnest(w) AS word
          FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)),
fixed AS (SELECT doc_id AS id, any_value(text) AS text,
          string_agg(coalesce(replacement, word), ' ' ORDER BY pos) AS normalized
          FROM split LEFT JOIN dictionary ON token = word GROUP BY doc_id)"""


@query("oov_normalize", f"{NORMALIZED} SELECT id, normalized FROM fixed")
def _oov_normalize(spark, sf):
    rows = X.normalize_words(inputs.texts(spark, sf), "id", "text", _dictionary(spark, sf)[0])
    return rows.select("id", "normalized")


@query("oov_changed", f"{NORMALIZED} SELECT id, normalized FROM fixed WHERE normalized <> text")
def _oov_changed(spark, sf):
    rows = X.normalize_words(inputs.texts(spark, sf), "id", "text", _dictionary(spark, sf)[0])
    return rows.filter("normalized <> text").select("id", "normalized")


@query("normalized_tokens", f"""
{NORMALIZED} SELECT id, array_to_string({sql.tokens('normalized')}, ' ') AS tokens FROM fixed
""")
def _normalized_tokens(spark, sf):
    rows = X.normalize_words(inputs.texts(spark, sf), "id", "text", _dictionary(spark, sf)[0])
    return rows.select("id", _joined(X.tokenize(F.col("normalized"))).alias("tokens"))


# --- tokens ------------------------------------------------------------------------------------


@query("word_split", f"""
SELECT doc_id AS id, array_to_string({sql.kept_words('text')}, ' ') AS words FROM documents
""")
def _word_split(spark, sf):
    return inputs.texts(spark, sf).select("id", _joined(X.split_words(F.col("text"))).alias("words"))


@query("subword_split", f"""
SELECT doc_id AS id, array_to_string({sql.subwords(sql.kept_words('text'))}, ' ') AS parts FROM documents
""")
def _subword_split(spark, sf):
    parts = X.split_subwords(X.split_words(F.col("text")))
    return inputs.texts(spark, sf).select("id", _joined(parts).alias("parts"))


@query("stop_filter", f"""
SELECT doc_id AS id, array_to_string(list_filter(string_split(text, ' '),
       lambda t: lower(t) NOT IN {sql.text_list(W.stop_words(True))}), ' ') AS tokens FROM documents
""")
def _stop_filter(spark, sf):
    tokens = X.drop_stop_words(F.split("text", " ", -1), W.stop_words(flash_mob=True))
    return inputs.texts(spark, sf).select("id", _joined(tokens).alias("tokens"))


@query("length_filter", """
SELECT doc_id AS id, array_to_string(list_filter(string_split(text, ' '),
       lambda t: length(t) BETWEEN 3 AND 50), ' ') AS tokens FROM documents
""")
def _length_filter(spark, sf):
    tokens = X.keep_lengths(F.split("text", " ", -1))
    return inputs.texts(spark, sf).select("id", _joined(tokens).alias("tokens"))


@query("stem_plural", f"""
WITH parts AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{sql.AN}]+')) AS token FROM documents)
SELECT token, {sql.stem('token')} AS stem FROM parts
""")
def _stem_plural(spark, sf):
    parts = F.regexp_extract_all(F.lower("text"), F.lit(rf"[{W.ALNUM}]+"), F.lit(0))
    tokens = inputs.texts(spark, sf).select(F.explode(parts).alias("token")).distinct()
    return tokens.withColumn("stem", X.stem_plural(F.col("token")))


@query("tokenize", f"SELECT doc_id AS id, array_to_string({sql.tokens('text')}, ' ') AS tokens FROM documents")
def _tokenize(spark, sf):
    return inputs.texts(spark, sf).select("id", _joined(X.tokenize(F.col("text"))).alias("tokens"))


@query("stem_by_vocabulary", f"""
WITH texts AS (SELECT doc_id AS id, {sql.tokens('text', False)} AS w FROM documents),
vocabulary AS (SELECT DISTINCT unnest(w) AS t FROM texts),
tried AS (
  SELECT t, 0 AS rank, t[:-4] || 'y' AS stem FROM vocabulary WHERE ends_with(t, 'ies')
  UNION ALL SELECT t, 1, t[:-4] || 'y' FROM vocabulary WHERE ends_with(t, 'ied')
  UNION ALL SELECT t, 2, t[:-3] FROM vocabulary WHERE ends_with(t, 'es')
  UNION ALL SELECT t, 3, t[:-2] FROM vocabulary WHERE ends_with(t, 's') AND NOT ends_with(t, 'ss') AND NOT ends_with(t, 'us')
  UNION ALL SELECT t, 4, t[:-4] FROM vocabulary WHERE ends_with(t, 'ing')
  UNION ALL SELECT t, 5, t[:-5] FROM vocabulary WHERE ends_with(t, 'ing') AND t[-4] = t[-5]
  UNION ALL SELECT t, 6, t[:-3] FROM vocabulary WHERE ends_with(t, 'ed')
  UNION ALL SELECT t, 7, t[:-4] FROM vocabulary WHERE ends_with(t, 'ed') AND t[-3] = t[-4]
  UNION ALL SELECT t, 8, t[:-4] || 'e' FROM vocabulary WHERE ends_with(t, 'ing')
  UNION ALL SELECT t, 9, t[:-3] || 'e' FROM vocabulary WHERE ends_with(t, 'ed')),
stems AS (SELECT tried.t, arg_min(stem, rank) AS stem FROM tried JOIN vocabulary v ON v.t = stem WHERE length(stem) >= 3 GROUP BY tried.t),
rows AS (SELECT id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM texts),
stemmed AS (SELECT id, string_agg(coalesce(stem, t), ' ' ORDER BY pos) AS tokens FROM rows LEFT JOIN stems USING (t) GROUP BY id)
SELECT id, coalesce(tokens, '') AS tokens FROM texts LEFT JOIN stemmed USING (id)
""")
def _stem_by_vocabulary(spark, sf):
    words = spread(inputs.texts(spark, sf)).select("id", X.tokenize(F.col("text"), stem="none").alias("words"))
    return X.stem_by_vocabulary(words, "id", "words").select("id", _joined(F.col("tokens")).alias("tokens"))


@query("min_tokens", f"""
SELECT conv_id, turn, len(tokens) AS n FROM
(SELECT conv_id, turn, {sql.tokens('text', False)} AS tokens FROM conversations) WHERE len(tokens) >= 2
""")
def _min_tokens(spark, sf):
    turns = inputs.table(spark, sf, "conversations")
    rows = V.token_rows(turns, "conv_id", X.tokenize(F.col("text"), stem="none"), keep=["turn"])
    return rows.select(F.col("id").alias("conv_id"), "turn", F.size("tokens").cast("bigint").alias("n"))


@query("token_count", f"SELECT doc_id AS id, len({sql.tokens('text')}) AS n FROM documents")
def _token_count(spark, sf):
    return inputs.texts(spark, sf).select("id", F.size(X.tokenize(F.col("text"))).cast("bigint").alias("n"))


@query("hashtag_boost", f"WITH {sql.TWEETS} SELECT id, {sql.BOOSTED} AS boosted FROM tweets")
def _hashtag_boost(spark, sf):
    boosted = X.boosted_text(F.col("text"), F.col("split_hashtags"), F.col("hashtags"))
    return inputs.tweets(spark, sf).select("id", boosted.alias("boosted"))


@query("token_offsets", f"""
WITH found AS (SELECT doc_id AS id, {sql.words('text')} AS w FROM documents),
pieces AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM found)
SELECT id, pos, token, length(token) AS width FROM pieces
""")
def _token_offsets(spark, sf):
    texts = inputs.texts(spark, sf)
    parts = texts.select("id", X.text_parts(F.col("text")).alias("parts"))
    found = X.offset_words(spread(texts), "id", "text").join(parts, "id")
    # a token is what its text holds between its offsets
    rows = F.transform("words", lambda w: F.struct(
        w["pos"].cast("bigint").alias("pos"), X.held(F.col("parts"), w["start"], w["end"] - w["start"]).alias("token"),
        (w["end"] - w["start"]).cast("bigint").alias("width"),
    ))
    return found.select("id", F.inline(rows))


@query("repeated_patterns")
def _repeated_patterns(spark, sf):
    rows = inputs.texts(spark, sf)
    return rows.select(
        "id",
        F.array_join(X.elongations(F.col("text")), " ").alias("found"),
        X.without_elongations(F.col("text")).alias("cleaned"),
        X.is_elongated(F.col("text")).alias("elongated"),
    )


@query("split_hashtag", """
WITH tags AS (SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '),
  lambda w: upper(left(w, 1)) || substr(w, 2)), '') || CAST(p_size AS VARCHAR) AS tag FROM part)
SELECT tag, regexp_replace(tag, '([a-z])([A-Z])', '\\1 \\2', 'g') AS letters,
       regexp_replace(tag, '([^A-Z0-9])([A-Z0-9])', '\\1 \\2', 'g') AS digits FROM tags
""")
def _split_hashtag(spark, sf):
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    tag = F.concat(F.array_join(words, ""), F.col("p_size").cast("string"))
    tags = inputs.table(spark, sf, "part").select(tag.alias("tag")).distinct()
    return tags.select(
        "tag",
        _joined(X.split_camel(F.col("tag"))).alias("letters"),
        _joined(X.split_camel(F.col("tag"), digits=True)).alias("digits"),
    )


@query("emoticons", f"""
SELECT page_id, len(regexp_extract_all(html, {sql.text_literal(W.SMILEY)})) AS smileys,
       len(regexp_extract_all(html, {sql.text_literal(W.FROWNY)})) AS frownies FROM pages
""")
def _emoticons(spark, sf):
    found = X.emoticons(F.col("html"))
    return inputs.table(spark, sf, "pages").select(
        "page_id", *[found[c].cast("bigint").alias(c) for c in ("smileys", "frownies")]
    )


@query("emoticon_groups")
def _emoticon_groups(spark, sf):
    found = X.emoticons(F.col("html"))["emoticons"].cast("bigint")
    return inputs.table(spark, sf, "pages").select("page_id", found.alias("emoticons"))


@query("remove_accents", "SELECT doc_id AS id, strip_accents(text) AS text FROM documents")
def _remove_accents(spark, sf):
    return inputs.texts(spark, sf).select("id", X.remove_accents(F.col("text")).alias("text"))


# --- tagged words ------------------------------------------------------------------------------

def _pairs_text(pairs):
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("/", p["lemma"], p["tag"])), " ")


# some letters three times in a row, from some place on
ELONGATED = """len(list_filter(flatten(list_transform(range(1, length(word) // 3 + 1), lambda p:
  list_transform(range(1, length(word) - 3 * p + 2), lambda i: substr(word, i, p) = substr(word, i + p, p)
  AND substr(word, i, p) = substr(word, i + 2 * p, p) AND regexp_full_match(substr(word, i, p), '[a-zA-Z]+')))),
  lambda x: x)) > 0"""


@query("pos_filter", f"""
WITH {sql.TAGGED}, forms AS (SELECT word, {ELONGATED} AS elongated FROM (SELECT DISTINCT word FROM tagged)),
kept AS (SELECT id, string_agg(word || '/' || tag, ' ' ORDER BY pos) AS words FROM tagged JOIN forms USING (word)
  WHERE n > 2 AND NOT elongated AND tag NOT IN {sql.text_list(W.UNWANTED_TAGS)} GROUP BY id)
SELECT doc_id AS id, coalesce(words, '') AS words FROM documents LEFT JOIN kept ON id = doc_id
""")
def _pos_filter(spark, sf):
    kept = X.keep_content_words(F.col("tagged"))
    words = F.transform(kept, lambda t: F.concat_ws("/", t["word"], t["tag"]))
    return inputs.tagged_texts(spark, sf).select("id", F.array_join(words, " ").alias("words"))


@query("lemma_pos_pairs")
def _lemma_pos_pairs(spark, sf):
    return inputs.tagged_texts(spark, sf).select(
        "id",
        _pairs_text(X.lemma_tags(F.col("tagged"))).alias("pairs"),
        _pairs_text(X.lemma_tags(F.col("tagged"), split_parts=True)).alias("parts"),
    )


@query("proper_noun_boost", f"""
WITH {sql.TAGGED}
SELECT id, pos, CASE WHEN tag IN ('NNP', 'NNPS') AND n > 1 THEN 1.5 ELSE 1.0 END AS weight FROM tagged
""")
def _proper_noun_boost(spark, sf):
    rows = inputs.tagged_words(spark, sf)
    weight = X.proper_noun_weight(F.col("word"), F.col("tag"))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), weight.alias("weight"))


@query("lemma_filter", f"""
SELECT doc_id AS id, array_to_string(list_transform(list_filter(string_split(text, ' '),
       lambda w: length(w) > 2 AND regexp_full_match(w, '\\p{{L}}+')), lambda w: lower(w)), ' ') AS lemmas
FROM documents
""")
def _lemma_filter(spark, sf):
    lemmas = X.clean_lemmas(F.split("text", " ", -1))
    return inputs.texts(spark, sf).select("id", _joined(lemmas).alias("lemmas"))


# --- vectors -----------------------------------------------------------------------------------


def _rows(spark, sf):
    return V.token_rows(inputs.texts(spark, sf), "id", X.tokenize(F.col("text")))


@query("term_freq", f"WITH {sql.DOC_VECTORS} SELECT id, term, tf FROM tf")
def _term_freq(spark, sf):
    return V.term_freq(_rows(spark, sf)).filter("term IS NOT NULL").select("id", "term", "tf")


@query("term_freq_hashed", f"""
WITH {sql.DOC_VECTORS} SELECT id, bucket, CAST(sum(tf) AS BIGINT) AS tf FROM
(SELECT id, CAST('0x' || left(sha256(term), 13) AS BIGINT) % {V.HASH_SIZE} AS bucket, tf FROM tf) GROUP BY id, bucket
""")
def _term_freq_hashed(spark, sf):
    return V.hashed_term_freq(_rows(spark, sf))


@query("doc_freq", f"WITH {sql.DOC_VECTORS} SELECT term, df FROM dfs")
def _doc_freq(spark, sf):
    return V.doc_freq(V.term_freq(_rows(spark, sf))).filter("term IS NOT NULL")


@query("word_count", f"WITH {sql.DOC_VECTORS} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY term")
def _word_count(spark, sf):
    return V.word_count(_rows(spark, sf))


@query("idf", f"""
WITH {sql.DOC_VECTORS}
SELECT term, df, round(CASE WHEN df >= 2 THEN ln(((SELECT count(*) FROM tok) + 1) / (df + 1)) ELSE 0 END, 6) AS idf
FROM dfs
""")
def _idf(spark, sf):
    df = inputs.stored(V.doc_freq(V.term_freq(_rows(spark, sf))))
    return V.inverse_doc_freq(df).withColumn("idf", F.round("idf", 6))


@query("tfidf", f"WITH {sql.DOC_VECTORS} SELECT id, term, round(w, 6) AS w FROM vec")
def _tfidf(spark, sf):
    return inputs.vectors(spark, sf).select("id", "term", F.round("w", 6).alias("w"))


@query("tfidf_boosted", f"WITH {sql.TWEET_VECTORS} SELECT id, term, round(w, 6) AS w FROM vec")
def _tfidf_boosted(spark, sf):
    return inputs.boosted_vectors(spark, sf).select("id", "term", F.round("w", 6).alias("w"))


@query("l2_norm", f"WITH {sql.DOC_VECTORS} SELECT id, round(sqrt(sum(w * w)), 6) AS norm FROM vec GROUP BY id")
def _l2_norm(spark, sf):
    return V.l2_norm(inputs.vectors(spark, sf)).withColumn("norm", F.round("norm", 6))


@query("top_k_keywords", f"""
WITH {sql.DOC_VECTORS}
SELECT id, term, round(w, 6) AS w, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, term) AS rank
FROM vec QUALIFY rank <= 5
""")
def _top_k(spark, sf):
    rows = V.top_terms(inputs.vectors(spark, sf), 5)
    return rows.select("id", "term", F.round("w", 6).alias("w"), F.col("rank").cast("bigint").alias("rank"))


@query("term_weight", f"""
WITH {sql.DOC_VECTORS}
SELECT d.id, round(w, 6) AS weight FROM docs d LEFT JOIN vec ON vec.id = d.id AND term = 'sich'
""")
def _term_weight(spark, sf):
    packed = V.pack(inputs.vectors(spark, sf))
    rows = inputs.texts(spark, sf).select("id").join(packed, "id", "left")
    return rows.select("id", F.round(F.try_element_at("weights", F.lit("sich")), 6).alias("weight"))


@query("vector_average", f"""
WITH {sql.DOC_VECTORS}
SELECT lang, term, round(avg(w), 6) AS w FROM vec JOIN documents ON doc_id = id GROUP BY lang, term
""")
def _vector_average(spark, sf):
    langs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    rows = inputs.vectors(spark, sf).join(langs, "id")
    return V.average_vectors(rows, "lang").withColumn("w", F.round("w", 6))


NEXT = f"""
WITH {sql.DENSE},
pairs AS (SELECT a.id, sum(a.w * b.w) AS dot, sqrt(sum(a.w * a.w)) * sqrt(sum(b.w * b.w)) AS norms
          FROM vec a JOIN vec b ON b.id = a.id + 1 AND a.term = b.term GROUP BY a.id)"""


def _next_pairs(spark, sf):
    """Every dense vector with the one of the next id."""
    packed = inputs.stored(V.pack(inputs.dense_vectors(spark, sf)))
    after = packed.select((F.col("id") - 1).alias("id"), F.col("weights").alias("other"))
    return packed.join(after, "id")


@query("dot_product", f"{NEXT} SELECT id, round(dot, 6) AS dot FROM pairs")
def _dot_product(spark, sf):
    dot = V.packed_dot(F.col("weights"), F.col("other"))
    return _next_pairs(spark, sf).select("id", F.round(dot, 6).alias("dot"))


@query("cosine_clamped", f"{NEXT} SELECT id, round(least(1.0, dot / norms), 6) AS cos FROM pairs")
def _cosine_clamped(spark, sf):
    cos = V.packed_cosine(F.col("weights"), F.col("other"))
    return _next_pairs(spark, sf).select("id", F.round(cos, 6).alias("cos"))


# --- series ------------------------------------------------------------------------------------


@query("ema", """
WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r,
           count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * pow(0.5, CASE WHEN r = n THEN n - 1 ELSE r END)), 6) AS ema FROM s GROUP BY user_id
""")
def _ema(spark, sf):
    rows = series.moving_average(inputs.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return rows.withColumn("ema", F.round("ema", 6))


@query("ema_running", """
SELECT user_id, event_id, round(list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS UNBOUNDED PRECEDING), lambda s, x: x / 3 + 2 * s / 3), 6) AS ema FROM events
""")
def _ema_running(spark, sf):
    """The average of a user's values at every event. Thirds never lie half-way between two roundings."""
    rows = series.running_average(inputs.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 1 / 3)
    return rows.select("user_id", "event_id", F.round("ema", 6).alias("ema"))


@query("series_mean", "SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def _series_mean(spark, sf):
    rows = series.series_mean(inputs.table(spark, sf, "events"), "user_id", "value")
    return rows.withColumn("mean", F.round("mean", 6))

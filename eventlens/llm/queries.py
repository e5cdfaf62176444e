"""One query per operator over the given tables, and the SQL that SQL can say."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import (
    chat, fingerprints, importance, jaccard, licences, merkle, mixing, neighbours, packing, runs, scoring, spans, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"
REJECT = 0.7


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


#: What goes to Python at once: texts are long, and a batch is in memory several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The file of the vocabulary, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Fields of the tools that conversations are turned into calls of.
TOOL_FIELDS = [
    ("search", "limit", "integer", True, 1.0, 50.0),
    ("search", "query", "string", True, 1.0, 40.0),
    ("summarise", "percent", "integer", True, 1.0, 100.0),
    ("summarise", "text", "string", True, 1.0, 800.0),
    ("translate", "text", "string", True, 1.0, None),
    ("translate", "to", "string", False, 2.0, 2.0),
]


@query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool calls: a user's turn is a call that depends on the user's turn before,
    the turn of the assistant after it is its result."""
    turns = table(spark, sf_dir, "conversations")
    n = F.length("text")

    def name(turn) -> F.Column:
        return F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    tool = F.when(n % 3 == 0, "search").when(n % 3 == 1, "translate").when(n % 3 == 2, "summarise")
    # the keys come in no order and with blanks, as models write them
    arguments = (
        F.when(n % 3 == 0, F.concat(F.lit('{"query": '), F.expr("substring(to_json(to_variant_object(struct(text AS x))), 6)")))
        .when(n % 3 == 1, F.concat(F.lit('{ "to":"de", "text" : '), F.expr("substring(to_json(to_variant_object(struct(text AS x))), 6)")))
        .otherwise(F.concat(F.lit('{"text": '), F.expr("substring(to_json(to_variant_object(struct(text AS x))), 6)")))
    )
    tail = F.when(n % 3 == 0, F.concat(F.lit(', "limit": '), (n % 60).cast("string"), F.lit(" }"))).when(
        n % 3 == 2, F.concat(F.lit(', "percent":'), (n % 120).cast("string"), F.lit("}"))
    )
    whole = F.when(tail.isNull(), arguments).otherwise(F.concat(F.expr("substring(a, 1, length(a) - 1)"), tail))
    calls = turns.filter("role = 'user'").withColumn("a", arguments).select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("tool"), whole.alias("arguments"),
        F.array(name(F.col("turn") - 2)).alias("depends_on"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOL_FIELDS, "tool string, field string, type string, required boolean, least double, most double")
    return chat.link(calls, results, schemas).withColumn("errors", F.concat_ws("; ", "errors"))


ORACLES["op1_chat"] = """
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, role, text, length(text) AS n, 'call-' || conv_id || '-' || turn AS own FROM conversations),
calls AS (SELECT * FROM turns WHERE role = 'user'),
results AS (SELECT conv_id, turn, text, 'call-' || conv_id || '-' || (turn - 1) AS call_id FROM turns WHERE role = 'assistant'),
depth AS (
    SELECT conv_id, turn, own, 0 AS level FROM calls c
    WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
    UNION ALL
    SELECT c.conv_id, c.turn, c.own, d.level + 1 FROM depth d JOIN calls c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2)
SELECT c.conv_id, c.own AS call_id, c.turn,
    CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'summarise' END AS tool, d.level,
    CASE WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END AS n_results,
    concat_ws('; ',
        CASE WHEN n % 3 = 0 AND n % 60 NOT BETWEEN 1 AND 50 THEN 'limit: range' END,
        CASE WHEN n % 3 = 2 AND n % 120 NOT BETWEEN 1 AND 100 THEN 'percent: range' END,
        CASE WHEN n % 3 = 0 AND (n = 0 OR n > 40) THEN 'query: length' END,
        CASE WHEN n % 3 = 2 AND n > 800 THEN 'text: length' END) AS errors,
    CASE n % 3 WHEN 0 THEN json_object('limit', n % 60, 'query', c.text)
        WHEN 1 THEN json_object('text', c.text, 'to', 'de')
        ELSE json_object('percent', n % 120, 'text', c.text) END::VARCHAR AS arguments,
    CASE WHEN r.call_id IS NOT NULL THEN json_object('text', r.text)::VARCHAR END AS result
FROM calls c JOIN depth d ON d.own = c.own LEFT JOIN results r ON r.call_id = c.own
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, NULL, NULL, 'orphan', 1, '', NULL, json_object('text', r.text)::VARCHAR
FROM results r WHERE r.call_id NOT IN (SELECT own FROM calls)
"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", F.coalesce(toxicity.fold("doc_id") == 1, F.lit(False)).alias("held_out"), toxicity.score("text", model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture wants it, with its block and its place there."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.xxhash64("text").alias("mark"), mixing.token_count("text").alias("mix_tokens")
    )
    docs = cut(docs, "counted")  # texts are read once
    mixed = mixing.mixture(docs, target_entropy=0.95, max_repeats=4.0)
    return mixing.schedule(docs, mixed, id_cols=("doc_id", "mark")).select(
        "doc_id", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_pass").alias("pass"),
        F.col("mix_before").alias("tokens_before"), F.col("mix_block").alias("block"), F.col("mix_order").alias("block_order"),
    )


@query
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs, removed="removed").select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", "text"
    )


ORACLES["op4_sentence_spans"] = r"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, text, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS i
    FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS tokens FROM texts)),
plain AS (SELECT *, regexp_extract(token, '^[^\x20\x09-\x0D]+') AS w FROM words),
lower_words AS (SELECT *, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lw,
    regexp_matches(w, '[.!?…。！？।॥؟۔]["'')\]}]*$') OR contains(token, chr(10)) AS ends FROM plain),
sums AS (SELECT lw, xor(4294967295::BIGINT, list_reduce(list_transform(range(1, strlen(lw) + 1), lambda k: ('0x' || hex(encode(lw))[2 * k - 1:2 * k])::BIGINT),
    lambda c, b: list_reduce(range(8), lambda r, k: xor(r >> 1, (r & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT)) AS crc
    FROM (SELECT DISTINCT lw FROM lower_words)),
placed AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
    FROM lower_words JOIN sums USING (lw)),
sized AS (SELECT *, count(*) OVER s AS n, row_number() OVER (s ORDER BY i) - 1 AS spot FROM placed WINDOW s AS (PARTITION BY doc_id, text, sentence)),
least AS (SELECT *, min(crc * 1000000 - i) OVER (PARTITION BY doc_id, text, sentence ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m FROM sized),
cuts AS (SELECT DISTINCT doc_id, text, (1000000 - m % 1000000) % 1000000 AS i FROM least WHERE n > 11 AND spot + 10 <= n),
begun AS (SELECT l.*, l.spot = 0 OR c.i IS NOT NULL AS begins FROM least l LEFT JOIN cuts c USING (doc_id, text, i)),
numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, text ORDER BY i) - 1 AS unit FROM begun),
units AS (SELECT doc_id, text, unit, count(*) AS n, string_agg(token, '' ORDER BY i) AS piece, string_agg(lw, ' ' ORDER BY i) AS words
    FROM numbered GROUP BY doc_id, text, unit),
rows_of AS (SELECT doc_id, text, list(n ORDER BY unit) AS sizes, list(piece ORDER BY unit) AS pieces, list(words ORDER BY unit) AS words FROM units GROUP BY doc_id, text),
starts AS (SELECT *, unnest(range(1, len(sizes) + 1)) AS a FROM rows_of),
pairs AS (SELECT *, unnest(range(a, least(a + 31, len(sizes) + 1))) AS b FROM starts),
spans AS (SELECT doc_id, text, a, b, array_to_string(words[a:b], ' ') AS span FROM pairs
    WHERE list_sum(sizes[a:b]) >= 21 AND list_sum(sizes[a:b]) - greatest(sizes[a], sizes[b]) < 21),
later AS (SELECT *, rank() OVER (PARTITION BY span ORDER BY doc_id, text, a, b) AS place FROM spans),
gone AS (SELECT doc_id, text, list_sort(list_distinct(flatten(list(range(a - 1, b))))) AS removed FROM later WHERE place > 1 GROUP BY doc_id, text)
SELECT doc_id, coalesce(len(removed), 0) AS n_removed, coalesce(list_transform(removed, lambda x: x::INTEGER), []) AS removed,
    CASE WHEN removed IS NULL THEN d.text ELSE regexp_extract(d.text, '^[\x20\x09-\x0D]*') || array_to_string(list_transform(
        list_filter(range(1, len(pieces) + 1), lambda i: NOT list_contains(removed, i - 1)), lambda i: pieces[i]), '') END AS text
FROM documents d LEFT JOIN gone USING (doc_id, text) LEFT JOIN rows_of USING (doc_id, text)
"""


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


#: Rows of good text that the target model is fitted on, at most; and the share of rows drawn.
TARGET_ROWS, DRAWN = 20_000, 0.8


@query
def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by likeness to those labelled good; a row that is here is drawn."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    target = good.orderBy(F.xxhash64("id"), "id").limit(TARGET_ROWS)
    drawn = importance.resample(table(spark, sf_dir, "documents"), target, DRAWN)
    return drawn.select(F.col("id").alias("doc_id"), "log_weight", "key")


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", licences.licences("text").alias("found")).select("doc_id", "found.*")


def template_pattern(template: str) -> str:
    """The wordings of a template as a pattern over words with a blank after each."""
    out = ""
    for part in template.replace("[", " [ ").replace("]", " ] ").split():
        if part in "[]":
            out += "(" if part == "[" else ")?"
        elif "," in part:
            out += f"([^ ]+ ){part}"
        else:
            out += f"({part.strip('{}')}) "
    return out


def _phrase_places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))
    return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {same})"


_LABELS = {label: f"len({_phrase_places(phrase)}) > 0" for phrase, label in licences.PHRASES.items()}
_TEMPLATE_LABELS = {label: f"regexp_matches(line, ' {template_pattern(t)}')" for label, t in licences.TEMPLATES.items()}


def _label_list(labels: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in labels.items())
    return f"array_to_string(list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)), ',')"


LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op7_licences"] = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWER_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lines AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line,
          list_concat({", ".join(_phrase_places(p) for p in licences.PHRASES)}) AS places FROM words),
found AS (SELECT *, {_label_list(_LABELS)} AS base_labels, {_label_list(_LABELS | _TEMPLATE_LABELS)} AS labels FROM lines)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       base_labels, labels, CASE WHEN labels <> base_labels THEN 1.0 WHEN base_labels <> '' THEN 0.5 ELSE 0.0 END AS score
FROM found
"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


ORACLES["op9_jaccard"] = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER_ASCII}, '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT DISTINCT doc_id, run FROM (SELECT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id
    JOIN sizes n ON n.doc_id = a.doc_id JOIN sizes m ON m.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, n.n, m.n HAVING 100 * count(*) >= 75 * (n.n + m.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN links ON a = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, min(other)) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_next(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def crc32_sql(column: str) -> str:
    """The unsigned crc32 of a number's decimal digits, bit by bit."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_transform(string_split({column}::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
        lambda c, b: list_reduce(range(8), lambda r, k: xor(r >> 1, (r & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT))"""


@query
def op11_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under a model learnt from four fifths of them."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = scoring.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


#: The fields of a leaf of the manifest.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def lower_ascii(text: str) -> F.Column:
    return F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the hash trees of its language, and whether its text still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.digest(merkle.encoded(*LEAF_FIELDS[:4], lower_ascii("text"))))
    leaves = merkle.stored_leaves(docs, merkle.digest(merkle.encoded(*LEAF_FIELDS)), "doc_id", "lang", F.unhex(tampered).alias("tampered"))
    found = merkle.manifest(leaves, "lang", "doc_id", "leaf")
    now = F.coalesce(F.lower(F.hex("item.tampered")), F.col("leaf"))
    folded = found.withColumn("folded_root", merkle.fold(now, "witness"))
    return folded.select(
        "item.doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings("witness"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _encoded_sql(text: str) -> str:
    fields = [*LEAF_FIELDS[:4], text]
    return " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}::VARCHAR)) || ':' || {f} END" for f in fields)


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, sha256({_encoded_sql("text")}) AS leaf,
    CASE WHEN {crc32_sql("doc_id")} % 3 = 0
        THEN sha256({_encoded_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
trees AS (SELECT lang, 0 AS level, idx, n, leaf AS h FROM numbered
    UNION ALL SELECT lang, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
    FROM trees WHERE n > 1 GROUP BY lang, level, idx // 8, n),
subroots AS (SELECT lang, level AS top, h, row_number() OVER (ORDER BY lang COLLATE "binary" NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
    FROM trees WHERE n = 1),
upper_tree AS (SELECT 0 AS level, idx, n, h FROM subroots
    UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_tree WHERE n > 1 GROUP BY level, idx // 8, n),
nodes AS (SELECT t.lang, t.level, t.idx, t.h FROM trees t WHERE t.n > 1
    UNION ALL SELECT s.lang, s.top + u.level, u.idx, u.h FROM subroots s, upper_tree u WHERE u.n > 1),
places AS (SELECT l.doc_id, l.lang, l.idx AS row_idx, l.leaf, l.tampered, k AS level,
    CASE WHEN k < s.top THEN l.idx // (8 ** k)::BIGINT ELSE s.idx // (8 ** (k - s.top))::BIGINT END AS at
    FROM numbered l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang, (SELECT max(level) AS deepest FROM nodes) d, range(0, d.deepest + 1) r(k)),
runs AS (SELECT p.lang, p.row_idx, p.level,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx < p.at), '') AS l,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx > p.at), '') AS r
    FROM places p JOIN nodes o ON o.lang IS NOT DISTINCT FROM p.lang AND o.level = p.level AND o.idx // 8 = p.at // 8
    GROUP BY p.lang, p.row_idx, p.level),
proofs AS (SELECT lang, row_idx, sha256(string_agg(l || r, '' ORDER BY level)) AS proof, list({{'l': l, 'r': r}} ORDER BY level) AS steps
    FROM runs GROUP BY lang, row_idx),
told AS (SELECT n.doc_id, n.leaf, s.h AS subroot, (SELECT h FROM upper_tree WHERE n = 1) AS root,
    coalesce(p.proof, sha256('')) AS proof_sha256, coalesce(n.tampered, n.leaf) AS now, p.steps
    FROM numbered n JOIN subroots s ON s.lang IS NOT DISTINCT FROM n.lang
    LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM n.lang AND p.row_idx = n.idx),
folded AS (SELECT *, list_reduce(list_transform(coalesce(steps, []), lambda s: s.l || '.' || s.r),
    lambda h, s: sha256(replace(s, '.', h)), now) AS folded_root FROM told)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


WORD = r"[^\x20\x09-\x0D]+"


def _repeated_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: in the texts whose id's checksum 10 divides, the words from some place on are
    its first few ones again and again."""
    digits = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select(
        "doc_id", "text", F.floor(digits / 10).alias("g"),
        F.when(digits % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"),
    )
    at = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    sized = at.withColumn("p", F.expr("int(1 + floor((n - a) / (3 + g % 8)))"))
    again = F.expr("transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE element_at(w, int(a + (i - a) % p) + 1) END)")
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of runs of each document, the one with most periods, and digests of all runs and of what is left."""
    docs = _repeated_tails(table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", runs.collapse("text").alias("found")).select("doc_id", "found.*")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # of equal exponents the first stays, as runs are in order
    best = F.expr("""aggregate(slice(runs, 2, greatest(size(runs), 1)), get(runs, 0), (best, r) ->
        CASE WHEN r.length * best.period > best.length * r.period THEN r ELSE best END)""")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs by equal windows of 16 words: words ``q`` apart agree on a stretch of at least 16, that is on
#: consecutive windows; of the periods of one stretch the smallest counts.
ORACLES["op13_periodic_runs"] = rf"""
WITH given AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS o, {crc32_sql("doc_id")} AS h FROM documents),
placed AS (SELECT *, len(o) AS n, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM given),
sized AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
texts AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS w FROM sized),
windows AS (SELECT doc_id, i, hash(w[i + 1:i + 16]) AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 15)) AS i FROM texts)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.win = y.win AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 16 + q AS m
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same) GROUP BY doc_id, q, part),
runs AS (SELECT doc_id, s, m, min(q) AS q FROM islands WHERE m >= 24 AND m >= 3 * q GROUP BY doc_id, s, m),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min({{'s': s, 'm': m, 'q': q}}, {{'e': -(m::DOUBLE / q), 's': s, 'q': q}}) AS best,
    list_distinct(flatten(list(range(s + q, s + m)))) AS gone FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS rest FROM (
    SELECT doc_id, w, gone, unnest(range(0, len(w))) AS i FROM texts LEFT JOIN told USING (doc_id))
    WHERE gone IS NULL OR NOT list_contains(gone, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.m AS length, best.q AS period,
    1000 * best.m // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

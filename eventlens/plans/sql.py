"""Pieces of the checking SQL (DuckDB). They take other ways than the Spark code where there are
any: brute-force joins, recursive unions, replace-then-split instead of look-around."""

from __future__ import annotations

from ..functions import words as W
from .inputs import URI

AN = W.ALNUM
LM = r"\p{L}\p{M}"
N = r"\p{N}"


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values: list[str]) -> str:
    return "(" + ", ".join(text_literal(v) for v in values) + ")"


def words(text: str) -> str:
    """Unicode words: joiners that join nothing are blanked out first. Twice, since two of them
    may share a character."""
    letters, digits = W.LETTER_JOINERS, W.DIGIT_JOINERS
    only_digit = "".join(c for c in digits if c not in letters)
    only_letter = "".join(c for c in letters if c not in digits)
    either = letters + only_digit
    breaks = [
        (f"([{LM}])[{letters}]([\\p{{M}}{N}_])"),
        (f"([{LM}])[{only_digit}]([{AN}_])"),
        (f"({N})[{digits}]([{LM}_])"),
        (f"({N})[{only_letter}]([{AN}_])"),
        (f"(_)[{either}]([{AN}_])"),
    ]
    for _ in range(2):
        for pattern in breaks:
            text = f"regexp_replace({text}, {text_literal(pattern)}, '\\1 \\2', 'g')"
    whole = text_literal(f"[{AN}_]+(?:[{either}][{AN}_]+)*")
    return f"regexp_extract_all({text}, {whole})"


def kept_words(text: str) -> str:
    return f"list_filter({words(text)}, lambda w: length(w) <= 50)"


def subwords(word_list: str) -> str:
    return (
        f"flatten(list_transform({word_list}, lambda w: CASE WHEN regexp_full_match(w, '[{AN}]+') THEN [w] "
        f"ELSE list_filter(regexp_extract_all(w, '[{AN}]+'), lambda p: NOT regexp_matches(p, '^{N}')) END))"
    )


def stem(t: str) -> str:
    return (
        f"CASE WHEN ends_with({t}, 'ies') AND NOT regexp_matches({t}, '[ea]ies$') "
        f"THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN ends_with({t}, 'es') AND NOT regexp_matches({t}, '[aeo]es$') THEN left({t}, length({t}) - 1) "
        f"WHEN ends_with({t}, 's') AND NOT regexp_matches({t}, '[us]s$') THEN left({t}, length({t}) - 1) "
        f"ELSE {t} END"
    )


def tokens(text: str, stemmed: bool = True) -> str:
    lowered = f"list_transform({subwords(kept_words(text))}, lambda t: lower(t))"
    kept = (
        f"list_filter({lowered}, lambda t: length(t) BETWEEN 3 AND 50 AND t NOT IN {text_list(W.stop_words())})"
    )
    return f"list_transform({kept}, lambda t: {stem('t')})" if stemmed else kept


HASHTAGS = (
    "list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda h: regexp_matches(h, '^[A-Z][a-z]{7,}$'))"
)

TWEETS = f"""
tagged AS (SELECT doc_id AS id, text, lang, ts AS created_at, {HASHTAGS} AS hashtags
           FROM documents JOIN events ON doc_id = event_id),
tweets AS (SELECT *, CASE WHEN lang = 'en' THEN lower(array_to_string(hashtags, ' ')) END AS split_hashtags
           FROM tagged)"""

BOOSTED = "text || ' ' || coalesce(split_hashtags, '') || ' ' || array_to_string(hashtags, ' ')"


def vectors(source: str, text: str) -> str:
    """CTEs ``tok, tf, dfs, vec`` over a source with ``id``."""
    return f"""
tok AS (SELECT id, tokens FROM (SELECT id, {tokens(text)} AS tokens FROM {source}) WHERE len(tokens) >= 2),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM tok) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
vec AS (SELECT id, term, df, tf * ln(((SELECT count(*) FROM tok) + 1) / (df + 1)) AS w
        FROM tf JOIN dfs USING (term) WHERE df >= 2 AND df < (SELECT count(*) FROM tok))"""


DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
DOC_VECTORS = f"{DOCS}, {vectors('docs', 'text')}"
TWEET_VECTORS = f"{TWEETS}, {vectors('tweets', BOOSTED)}"
DENSE = (
    "vec AS (SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS VARCHAR) AS term, "
    "CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings)"
)


def sign(digest: str, function: int) -> str:
    place = function % 240
    return f"(((strpos('0123456789abcdef', substr({digest}, {place // 4 + 1}, 1)) - 1) >> {3 - place % 4}) & 1)"


def signatures(rows: int, bands: int, seed: int = 42, vec: str = "vec") -> str:
    """CTEs ``signed, dots, sigs``: ``sigs`` is ``(id, sigs)``."""
    count = rows * bands
    blocks = range((count + 239) // 240)
    digests = ", ".join(f"sha256('{seed}.{b}:' || term) AS h{b}" for b in blocks)
    sums = ", ".join(
        f"CASE WHEN round(sum(CASE WHEN {sign(f'h{i // 240}', i)} = 1 THEN w ELSE -w END), 9) > 0 "
        f"THEN '1' ELSE '0' END AS b{i}"
        for i in range(count)
    )
    bands_sql = ", ".join(" || ".join(f"b{t + r * bands}" for r in range(rows)) for t in range(bands))
    return f"""
signed AS (SELECT term, {digests} FROM (SELECT DISTINCT term FROM {vec})),
bits AS (SELECT id, {sums} FROM {vec} JOIN signed USING (term) GROUP BY id),
sigs AS (SELECT id, [{bands_sql}] AS sigs FROM bits),
tables AS (SELECT CAST(unnest(range({bands})) AS INTEGER) AS table_id, unnest(sigs) AS sig, id FROM sigs)"""


COSINES = """
units AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM vec),
cosines AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 9) AS cos
            FROM units a JOIN units b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id)"""

POINTS = """
pts AS (SELECT event_id AS id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 3.6e9 AS x, value AS y
        FROM events)"""


def point_pairs(eps: float, distance: str | None = None) -> str:
    """CTE ``near``: ``(src, dst, distance)``, ``src < dst``."""
    d = distance or "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
    return f"""
near AS (SELECT a.id AS src, b.id AS dst, round({d}, 9) AS distance
         FROM pts a JOIN pts b ON b.x BETWEEN a.x - {eps + 0.1} AND a.x + {eps + 0.1} AND a.id < b.id
         WHERE round({d}, 9) <= {eps})"""


def clusters(rule: str, members: str = "pts", weight: str = "1", own: int = 0) -> str:
    """CTEs from ``near`` ``(src, dst)``: ``nb, counts, cores, links, reach, labels``; border
    members bridge clusters."""
    return f"""
nb AS (SELECT src, dst, {weight} AS weight FROM near UNION ALL SELECT dst, src, {weight} FROM near),
counts AS (SELECT id, CAST({own} + coalesce(n, 0) AS BIGINT) AS n FROM {members}
           LEFT JOIN (SELECT src AS id, sum(weight) AS n FROM nb GROUP BY src) USING (id)),
cores AS (SELECT id FROM counts WHERE n {rule}),
core_links AS (SELECT src, dst FROM nb JOIN cores ON src = id),
links AS (SELECT src, dst FROM core_links UNION SELECT dst, src FROM core_links),
reach AS (SELECT DISTINCT src AS id, src AS label FROM links
          UNION SELECT l.dst, r.label FROM reach r JOIN links l ON l.src = r.id WHERE l.dst > r.label),
labels AS (SELECT id, min(label) AS cluster FROM reach GROUP BY id)"""


CORE_CLUSTERS = """
core_links AS (SELECT src, dst FROM nb JOIN cores c ON src = c.id JOIN cores d ON dst = d.id),
reach AS (SELECT id, id AS label FROM cores
          UNION SELECT l.dst, r.label FROM reach r JOIN core_links l ON l.src = r.id WHERE l.dst > r.label),
core_labels AS (SELECT id, min(label) AS cluster FROM reach GROUP BY id),
claims AS (SELECT DISTINCT dst AS id, cluster FROM nb JOIN core_labels c ON src = c.id
           WHERE dst NOT IN (SELECT id FROM cores)),
labels AS (SELECT id, cluster FROM core_labels UNION ALL SELECT id, min(cluster) FROM claims GROUP BY id)"""


def core_clusters(rule: str) -> str:
    """Like ``clusters`` with clusters joined by cores only and border members in the smallest."""
    return f"""
nb AS (SELECT src, dst FROM near UNION ALL SELECT dst, src FROM near),
counts AS (SELECT id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM pts
           LEFT JOIN (SELECT src AS id, count(*) AS n FROM nb GROUP BY src) USING (id)),
cores AS (SELECT id FROM counts WHERE n {rule}),{CORE_CLUSTERS}"""


TAGGED = """
pieces AS (SELECT doc_id AS id, unnest(range(len(w))) AS pos, unnest(w) AS word
           FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
words AS (SELECT *, CAST(sum(length(word) + 1) OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS "end",
          length(word) AS n, regexp_matches(word, '^[A-Z][a-z]+$') AS cap, regexp_matches(word, '^[a-z]+$') AS low
          FROM pieces),
tagged AS (SELECT id, pos, CAST("end" - n AS INTEGER) AS begin, "end", word, n,
           CASE WHEN cap AND n % 7 = 0 THEN 'JJ' WHEN cap AND n % 2 = 0 THEN 'NNP' WHEN cap THEN 'NNS'
                WHEN low AND n % 3 = 0 THEN 'NN' WHEN low AND n % 3 = 1 THEN 'VB' WHEN low THEN 'PRP'
                ELSE 'SYM' END AS tag,
           CASE WHEN n % 4 <> 0 THEN lower(word) END AS lemma FROM words)"""


def types_of(n: str) -> str:
    return (
        f"CASE {n} % 5 WHEN 0 THEN '' WHEN 1 THEN 'Schema:Place,DBpedia:Place,DBpedia:Person' "
        f"WHEN 2 THEN 'DBpedia:Agent,DBpedia:Person' WHEN 3 THEN 'DBpedia:Time' ELSE 'Freebase:/sports' END"
    )


def kind_of(n: str) -> str:
    return f"CASE {n} % 5 WHEN 1 THEN 'Where' WHEN 2 THEN 'Who' WHEN 3 THEN 'When' ELSE 'What' END"


ENTITIES = f"""{TAGGED},
entities AS (SELECT id, begin AS start, n AS width, CASE WHEN n = 10 THEN 'Day' ELSE word END AS surface,
             '{URI}' || CASE WHEN n = 9 THEN 'Music' ELSE word END AS uri,
             CASE n % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.81 ELSE 0.95 END AS score,
             CASE begin % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.51 ELSE 0.2 END AS second_rank,
             {types_of('n')} AS types, {kind_of('n')} AS kind
             FROM tagged WHERE regexp_matches(word, '^[A-Z][a-z]{{5,}}$')),
annotations AS (SELECT * FROM entities e WHERE score > 0.8 AND second_rank <= 0.5
                AND uri <> '{URI}Music' AND surface <> 'Day'
                AND EXISTS (SELECT 1 FROM tagged t WHERE t.id = e.id AND t.tag LIKE 'N%'
                            AND t.begin BETWEEN e.start AND e.start + length(e.surface)))"""

PART_RESOURCES = f"""
parts AS (SELECT p_partkey, p_size, '{URI}' || CAST(p_partkey AS VARCHAR) AS uri,
          list_concat(string_split(p_name, ' '), [p_brand]) AS in_links FROM part)"""

TAGS = f"""
tag_words AS (SELECT doc_id AS id, unnest(list_distinct({HASHTAGS})) AS word FROM documents),
tags AS (SELECT id, word, '{URI}' || word AS uri,
         [substr(word, 1, 2), substr(word, 3, 2), substr(word, 5, 2)] AS in_links FROM tag_words)"""

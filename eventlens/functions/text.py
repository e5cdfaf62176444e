"""Text functions: columns in, columns out, all inside Catalyst unless noted."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from ..skew import skew_join
from . import words as W

# Unicode words: runs of letters, marks, digits and underscores; two runs are one word when a
# joiner stands between two letters or between two digits.
WORD = (
    rf"[{W.ALNUM}_]+(?:(?:(?<=[\p{{L}}\p{{M}}])[{W.LETTER_JOINERS}](?=\p{{L}})"
    rf"|(?<=\p{{N}})[{W.DIGIT_JOINERS}](?=\p{{N}}))[{W.ALNUM}_]+)*"
)


# A sub-word without its word: letter runs, and number runs that nothing is joined to.
SUBWORD = (
    rf"(?<![{W.ALNUM}])(?:[\p{{L}}\p{{M}}][{W.ALNUM}]*+"
    rf"|(?<!_)(?<!\p{{N}}[{W.DIGIT_JOINERS}])\p{{N}}[{W.ALNUM}]*+"
    rf"(?!_|(?<=\p{{N}})[{W.DIGIT_JOINERS}]\p{{N}}|(?<=[\p{{L}}\p{{M}}])[{W.LETTER_JOINERS}]\p{{L}}))"
)
# Only such a run can hold a word that is too long to keep.
LONG_RUN = rf"[{W.ALNUM}_{W.LETTER_JOINERS}{W.DIGIT_JOINERS}]{{{W.MAX_TERM + 1}}}"


def split_words(text: Column, max_length: int = W.MAX_TERM) -> Column:
    """Unicode words of a text; longer ones are not kept. Null text gives no words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: F.length(w) <= max_length)


def split_subwords(tokens: Column) -> Column:
    """Cut words at their delimiters. A word without one passes as it is; of any other only the
    parts that begin with a letter are kept (``can't`` → can, t; ``3,000`` → nothing)."""
    return F.flatten(
        F.transform(
            tokens,
            lambda w: F.when(w.rlike(rf"^[{W.ALNUM}]+$"), F.array(w)).otherwise(
                F.filter(
                    F.regexp_extract_all(w, F.lit(rf"[{W.ALNUM}]+"), F.lit(0)),
                    lambda p: ~p.rlike(r"^\p{N}"),
                )
            ),
        )
    )


def drop_stop_words(tokens: Column, stop: list[str] | None = None) -> Column:
    """Remove stop words in any case; repeats of other tokens stay."""
    stop = W.stop_words() if stop is None else stop
    return F.filter(tokens, lambda t: ~F.lower(t).isin(stop))


def keep_lengths(tokens: Column, low: int = W.MIN_TERM, high: int = W.MAX_TERM) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(low, high))


def stem_plural(token: Column) -> Column:
    """Harman's S-stemmer: the first rule that applies."""

    def ends(*tails: str) -> Column:
        return functools.reduce(lambda x, y: x | y, [token.endswith(t) for t in tails])

    def cut_tail(n: int) -> Column:
        return F.left(token, F.length(token) - n)

    plural = (
        F.when(ends("ies") & ~ends("eies", "aies"), F.concat(cut_tail(3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes"), cut_tail(1))
        .when(~ends("us", "ss"), cut_tail(1))
        .otherwise(token)
    )
    return F.when(ends("s"), plural).otherwise(token)


def _has_long_run(text: Column) -> Column:
    """Whether a word may be too long to keep. No run holds a blank, so only long pieces between blanks are searched;
    a search of the whole text would try the pattern at every character."""
    return F.exists(F.split(text, " ", -1), lambda p: (F.length(p) > W.MAX_TERM) & p.rlike(LONG_RUN))


def subwords(text: Column) -> Column:
    """Same as splitting a text into words and those into sub-words, in one pass where no word
    can be over-long: every letter run, and every number run that is a word of its own."""
    quick = F.regexp_extract_all(text, F.lit(SUBWORD), F.lit(0))
    return F.when(_has_long_run(text), split_subwords(split_words(text))).otherwise(quick)


def tokenize(text: Column, stem: str = "s", stop: list[str] | None = None) -> Column:
    """The whole chain: words, sub-words, lower case, stop words, length, stem (``'s'`` or
    ``'none'``)."""
    if stem not in ("s", "none"):
        raise ValueError("stem must be 's' or 'none'")
    stop = W.stop_words() if stop is None else stop
    # only stop words that can pass the length bounds matter here
    stop = [w for w in stop if W.MIN_TERM <= len(w) <= W.MAX_TERM]
    kept = F.filter(
        subwords(F.lower(F.coalesce(text, F.lit("")))),
        lambda t: F.length(t).between(W.MIN_TERM, W.MAX_TERM) & ~t.isin(stop),
    )
    return F.transform(kept, stem_plural) if stem == "s" else kept


def stem_by_table(df: DataFrame, id_col: str, tokens: str, stems: DataFrame) -> DataFrame:
    """``(id, tokens)`` with each token's stem by a table ``(surface, stem)``, in order and with
    copies; tokens the table lacks stay, null tokens are an empty array. Of several stems of a
    surface the smallest counts. Ids are unique; use it on ``tokenize(..., stem='none')``.

    Only words that the table changes are joined and gathered, each once a text; a word of very many
    texts is split over tasks.
    """
    rows = cut(df.select(F.col(id_col).alias("id"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")), "tokens")
    table = stems.groupBy(F.col("surface").alias("token")).agg(F.min("stem").alias("stem")).filter("token <> stem")
    held = cut(rows.select("id", F.explode(F.array_distinct("tokens")).alias("token")), "text-words")
    rule = F.struct("token", "stem")
    hits = skew_join(held, table, ["token"]).groupBy(F.col("id").alias("own")).agg(F.map_from_entries(F.collect_list(rule)).alias("rules"))
    changed = F.transform("tokens", lambda t: F.coalesce(F.try_element_at("rules", t), t))
    return rows.join(hits, F.col("id").eqNullSafe(F.col("own")), "left").select(
        "id", F.when(F.col("rules").isNull(), F.col("tokens")).otherwise(changed).alias("tokens")
    )


# Endings and what may stand for them; a doubled letter before the last two pairs may also be single.
INFLECTIONS = (("ies", "y"), ("ied", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ed", ""), ("ing", "e"), ("ed", "e"))
MIN_STEM = 3


def _uninflected(token: Column) -> Column:
    """What a token may be a form of, as an array of ``(rank, stem)``, likelier stems first."""

    def body(ending: str) -> Column:
        return F.left(token, F.length(token) - len(ending))

    tried = []
    for ending, other in INFLECTIONS:
        fits = token.endswith(ending)
        if ending == "s":
            fits = fits & ~F.right(token, F.lit(2)).isin("ss", "us")
        tried.append(F.when(fits, F.concat(body(ending), F.lit(other))))
        if not other and ending in ("ing", "ed"):
            twice = F.right(body(ending), F.lit(1)) == F.substring(body(ending), -2, 1)
            tried.append(F.when(fits & twice, F.left(body(ending), F.length(body(ending)) - 1)))
    ranked = F.array(*[F.struct(F.lit(rank).alias("rank"), stem.alias("stem")) for rank, stem in enumerate(tried)])
    return F.filter(ranked, lambda c: F.length(c["stem"]) >= MIN_STEM)


def vocabulary_stems(terms: DataFrame) -> DataFrame:
    """``(surface, stem)`` of distinct terms ``(token)``: a form is led back to a word only if the corpus
    itself has that word as a term, so names and words that merely end alike stay. Of several the first of
    ``INFLECTIONS`` counts. One step is made: of ``buildings`` comes ``building``. Terms without a stem have no
    row, null has none. Both sides of the join have a word once, so no key is crowded.
    """
    words = cut(terms.filter("token IS NOT NULL").select("token").distinct(), "vocabulary")
    tried = words.select(F.col("token").alias("surface"), F.inline(_uninflected(F.col("token"))))
    known = tried.join(words.select(F.col("token").alias("stem")), "stem")
    return known.groupBy("surface").agg(F.min_by("stem", "rank").alias("stem"))


def stem_by_vocabulary(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """``(id, tokens)`` with inflected tokens led back to words of the same corpus; null tokens are an empty
    array. Ids are unique; use it on ``tokenize(..., stem='none')``."""
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens")), "tokens")
    return stem_by_table(rows, "id", "tokens", vocabulary_stems(rows.select(F.explode("tokens").alias("token"))))


def boosted_text(text: Column, split_tags: Column, tags: Column) -> Column:
    """Text followed by its hashtags, so that their terms count once more."""
    return F.concat(
        text, F.lit(" "), F.coalesce(split_tags, F.lit("")), F.lit(" "), F.array_join(tags, " ")
    )


#: Numbers that are added up one by one; a text's words are taken in blocks of as many, and blocks again.
OFFSET_BLOCK = 32


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, n: s + n)


def _sum_blocks(numbers: str) -> Column:
    """The sum of every block of an array column."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(numbers) / OFFSET_BLOCK).cast("int"))
    return F.transform(blocks, lambda b: _total(F.slice(numbers, b * OFFSET_BLOCK + 1, F.lit(OFFSET_BLOCK))))


def _before(numbers: str, bases: str, pos: Column) -> Column:
    """The sum of all numbers before ``pos``, given that of all blocks before each block."""
    block = F.floor(pos / OFFSET_BLOCK).cast("int")
    return F.get(bases, block) + _total(F.slice(numbers, block * OFFSET_BLOCK + 1, pos - block * OFFSET_BLOCK))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, by a generator, so that what is done with them does not compute
    them again for each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def word_pieces(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, tokens, gaps, widths, bases)``: the Unicode words of a text, the length of what lies before
    each, the length of both together, and where every block of ``OFFSET_BLOCK`` words begins."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.select(
        F.col(id_col).alias("id"),
        F.inline(F.array(F.struct(
            F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("tokens"),
            F.transform(F.split(text, WORD, -1), F.length).alias("gaps"),
        ))),
    )
    width = F.zip_with("tokens", "gaps", lambda t, g: F.coalesce(F.length(t), F.lit(0)) + g)
    found = pinned(pinned(found, widths=width), sums=_sum_blocks("widths"))
    found = pinned(found, tops=_sum_blocks("sums"))
    found = pinned(found, starts=F.transform("tops", lambda s, i: _total(F.slice("tops", F.lit(1), i))))
    bases = F.transform("sums", lambda s, b: _before("sums", "starts", b))
    return pinned(found, bases=bases).select("id", "tokens", "gaps", "widths", "bases")


def word_start(pos: Column) -> Column:
    """Where word ``pos`` of a row of ``word_pieces`` begins, in characters."""
    return _before("widths", "bases", pos) + F.get("gaps", pos)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _sums_before(numbers: pa.Array) -> pa.Array:
    """For every number of every array the sum of those before it in the array."""
    flat = numbers.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(flat)])
    offsets = numbers.offsets.to_numpy() - numbers.offsets[0].as_py()
    sums = upto[:-1] - np.repeat(upto[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums, pa.int32()))


def offset_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, words)``: the Unicode words of a text as an array ``(pos, token, start, end)``, offsets in characters;
    empty for a null or empty text. The pieces between the words give the offsets: nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = pinned(
        df.select(F.col(id_col).alias("id"), text.alias("text")),
        tokens=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        gaps=F.transform(F.split("text", WORD, -1), F.length),
    ).select("id", "tokens", F.slice("gaps", F.lit(1), F.size("tokens")).alias("gaps"))
    found = pinned(found, widths=F.transform("tokens", F.length))
    before = _sums_before(F.zip_with("widths", "gaps", lambda w, g: w + g))
    found = found.select("id", "tokens", "gaps", "widths", before.alias("before"))
    rows = F.arrays_zip("tokens", "gaps", "widths", "before")
    words = F.transform(rows, lambda r, i: F.struct(
        i.alias("pos"), r["tokens"].alias("token"), (r["before"] + r["gaps"]).alias("start"),
        (r["before"] + r["gaps"] + r["widths"]).alias("end"),
    ))
    return found.select("id", words.alias("words"))


def token_offsets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, token, start, end)`` of every Unicode word, offsets in characters; a null or
    empty text has none."""
    return offset_words(df, id_col, text_col).select("id", F.inline("words"))


#: Characters of a part of a text.
PART = 512


def text_parts(text: Column) -> Column:
    """A text as parts of ``PART`` characters, from which ``held`` reads without counting from the text's begin."""
    numbers = F.sequence(F.lit(0), F.floor(F.length(text) / PART).cast("int"))
    return F.transform(numbers, lambda k: F.substr(text, k * PART + 1, F.lit(PART)))


def held(parts: Column, start: Column, width: Column) -> Column:
    """What the text of ``text_parts`` holds from a character on."""
    begin = F.floor(start / PART).cast("int")
    count = F.floor((start + width) / PART).cast("int") - begin + 1
    return F.substr(F.array_join(F.slice(parts, begin + 1, count), ""), start - begin * PART + 1, width)


#: Entries of a dictionary that is put into the plan of its own query, at most.
SMALL_DICTIONARY = 2_000


def normalize_words(
    df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, small: int = SMALL_DICTIONARY
) -> DataFrame:
    """``(id, text, normalized)``: every blank-separated word that is a ``token`` of the
    dictionary is replaced. Case counts. A null text stays, with null.

    A dictionary of at most ``small`` entries becomes one map, looked up within the row: nothing is shuffled. A
    larger one is joined with the distinct words of distinct texts; of each text only the words that it has go on, a
    set by text, and copies of a text meet it by a hash, split where there are many.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rules = dictionary.filter("token IS NOT NULL AND replacement IS NOT NULL").groupBy("token").agg(F.max("replacement").alias("replacement"))
    rules = cut(rules, "dictionary")
    words = F.split("text", " ", -1)
    entry = F.struct("token", "replacement")
    if rules.count() <= small:
        known = rules.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("rules")).scalar()
        # a map is searched entry by entry, so it is narrowed to the words that a text has
        own = texts.withColumn("known", known).withColumn("hits", F.array_intersect(words, F.map_keys("known")))
        rule = F.map_filter("known", lambda k, v: F.array_contains("hits", k))
        own = own.select("id", "text", F.explode(F.array(F.when(F.size("hits") > 0, rule))).alias("rules"))
    else:
        own = _joined_rules(texts, rules, entry)
    changing = F.when(F.col("rules").isNotNull(), F.col("text"))
    replaced = _replace_words(changing, F.map_keys("rules"), F.map_values("rules"))
    return own.select("id", "text", F.coalesce(replaced, "text").alias("normalized"))


@F.arrow_udf(T.StringType())
def _replace_words(text: pa.Array, tokens: pa.Array, others: pa.Array) -> pa.Array:
    """Texts with their blank-separated words replaced by rules. A map of Spark is searched entry by entry for every
    word, which grows with the square of a long text; here it is a dictionary."""
    out = []
    for t, keys, values in zip(text.to_pylist(), tokens.to_pylist(), others.to_pylist()):
        rules = None if t is None else dict(zip(keys, values))
        out.append(None if t is None else " ".join([rules.get(w, w) for w in t.split(" ")]))
    return pa.array(out, pa.string())


def _joined_rules(texts: DataFrame, rules: DataFrame, entry: Column) -> DataFrame:
    """Texts with the rules for their words, which are joined with the dictionary once for each distinct text."""
    marked = cut(texts.withColumns({"mark": F.xxhash64("text"), "size": F.length("text")}), "marked-texts")
    once = marked.filter("text IS NOT NULL").dropDuplicates(["mark", "size"])
    held = once.select("mark", "size", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("token"))
    hits = skew_join(cut(held, "text-words"), rules, ["token"]).groupBy("mark", "size").agg(F.map_from_entries(F.collect_set(entry)).alias("rules"))
    return skew_join(marked, hits, ["mark", "size"], "left", row_id=["id"])


def elongations(text: Column) -> Column:
    """All stretches in which a group of letters is repeated three times or more."""
    return F.regexp_extract_all(text, F.lit(W.ELONGATED), F.lit(0))


def without_elongations(text: Column) -> Column:
    return F.regexp_replace(text, W.ELONGATED, " ")


def is_elongated(token: Column) -> Column:
    return token.rlike(W.ELONGATED)


def keep_content_words(tagged: Column, field: str = "word") -> Column:
    """Of tagged tokens keep those longer than two characters, not elongated, with a wanted tag."""
    return F.filter(
        tagged,
        lambda t: (F.length(t[field]) > 2)
        & ~is_elongated(t[field])
        & ~t["tag"].isin(W.UNWANTED_TAGS),
    )


def lemma_tags(tagged: Column, split_parts: bool = False, flash_mob: bool = True) -> Column:
    """``(lemma, tag)`` of the content words of a tagged text, without stop words.

    The word stands in for a missing lemma. ``split_parts`` is the variant that cuts lemmas at
    delimiters and keeps their case.
    """
    pairs = F.transform(
        tagged,
        lambda t: F.struct(F.coalesce(t["lemma"], t["word"]).alias("lemma"), t["tag"].alias("tag")),
    )
    pairs = keep_content_words(pairs, "lemma")
    if split_parts:
        pairs = F.flatten(
            F.transform(
                pairs,
                lambda p: F.transform(
                    split_subwords(F.array(p["lemma"])),
                    lambda part: F.struct(part.alias("lemma"), p["tag"].alias("tag")),
                ),
            )
        )
        # the library list is matched as it stands, the custom one in any case
        library, custom = W.LIBRARY_STOP_WORDS, W.CUSTOM_STOP_WORDS
        if flash_mob:
            custom = custom + W.FLASH_MOB_WORDS
        return F.filter(
            pairs, lambda p: ~p["lemma"].isin(library) & ~F.lower(p["lemma"]).isin(custom)
        )
    pairs = F.transform(
        pairs, lambda p: F.struct(F.lower(p["lemma"]).alias("lemma"), p["tag"].alias("tag"))
    )
    return F.filter(pairs, lambda p: ~p["lemma"].isin(W.stop_words(flash_mob)))


def proper_noun_weight(word: Column, tag: Column) -> Column:
    return F.when(
        tag.isin(W.PROPER_NOUN_TAGS) & (F.length(word) > 1), F.lit(W.PROPER_NOUN_WEIGHT)
    ).otherwise(F.lit(1.0))


def clean_lemmas(lemmas: Column) -> Column:
    """Lemmas longer than two characters that are letters only, in lower case."""
    kept = F.filter(lemmas, lambda x: (F.length(x) > 2) & x.rlike(r"^\p{L}+$"))
    return F.transform(kept, F.lower)


def split_camel(tag: Column, digits: bool = False) -> Column:
    return F.split(tag, W.CAMEL_DIGITS if digits else W.CAMEL_LETTERS)


def emoticons(text: Column) -> Column:
    """Counts of smileys, frownies and delimited emoticon groups."""

    def count(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    return F.struct(
        count(W.SMILEY).alias("smileys"),
        count(W.FROWNY).alias("frownies"),
        count(W.EMOTICON).alias("emoticons"),
    )


@F.pandas_udf(T.StringType())
def _decompose(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFD")


def remove_accents(text: Column) -> Column:
    """Decompose (in Arrow batches: Spark has no NFD function) and drop the combining marks."""
    beyond = F.when(text.rlike("[^\\x00-\\x7F]"), text)  # ASCII texts stay in the JVM's hands
    return F.coalesce(F.regexp_replace(_decompose(beyond), "[\u0300-\u036f]+", ""), text)

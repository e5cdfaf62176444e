"""Toxicity by compression distance: two zstandard dictionaries, one for toxic and one for
ordinary text.

A text is cut into windows of some words. Each window is compressed twice: with the dictionary of
ordinary text, and with that of toxic text placed before the same ordinary text. Whatever is
ordinary costs the same both times, so the difference in length is what the toxic dictionary
saves. A logistic curve over the largest savings, fitted on labelled texts that the dictionaries
have not seen, turns them into a score.

Edge cases: a null or empty text has no window, saves nothing and scores the base rate; a very
long text is scored over all its windows; equal texts score equally; without labelled rows of
both classes every text scores 0. A text labelled both ways counts as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, release

WINDOW_WORDS = 16
LEVEL = 9
SAMPLE = 2000
TOXIC_BYTES, ORDINARY_BYTES = 4096, 8192
TOXIC_WORDS, ORDINARY_WORDS = 2000, 30_000
LEAST_CONTEXTS, RATIO, SIGMAS = 4, 8.0, 5.0
MOST_SAVED = 12.0


def fold(doc_id: Column | str) -> Column:
    """``crc32`` of the id as text, modulo 3."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.encode(col.cast("string"), "utf-8")), F.lit(3))


@dataclass
class Model:
    """``toxic`` and ``ordinary`` are the dictionaries, ``weights`` the curve (constant first)."""

    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)
    window_words: int = WINDOW_WORDS
    level: int = LEVEL


def _labelled(labels: DataFrame, id_col: str, label: str, sample: int) -> DataFrame:
    """Up to ``sample`` ids of each class and fold, in the order of a hash: a bounded table."""
    one = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max((F.col(label) == 1).cast("int")).alias("toxic"))
        .withColumn("fold", fold("id"))
    )
    parts = [
        one.filter((F.col("toxic") == c) & (F.col("fold") == f)).orderBy(F.xxhash64("id"), "id").limit(sample)
        for c in (0, 1) for f in (0, 2)
    ]
    return reduce(DataFrame.unionByName, parts)


def _texts(docs: DataFrame, labelled: DataFrame, id_col: str, text: str) -> DataFrame:
    ids = F.broadcast(labelled)  # at most four times the sample
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(ids, "id")


def _word_counts(texts: DataFrame) -> DataFrame:
    """Numbers of distinct contexts of each word in toxic (``t``) and ordinary (``o``) texts of the
    folds 0 and 2: copies of a text add none."""
    words = F.split(F.trim("text"), r"\s+")
    around = "transform(sequence(1, size(w)), i -> struct(w[i - 1] AS word, xxhash64(get(w, i - 2), get(w, i)) AS around))"
    return cut(
        texts.filter("text IS NOT NULL")
        .select("toxic", "fold", words.alias("w"))
        .select("toxic", "fold", F.explode(F.expr(around)).alias("e"))
        .filter("e.word <> ''")
        .select("toxic", "fold", "e.word", "e.around")
        .distinct()
        .groupBy("word")
        .agg(*[
            F.count_if((F.col("toxic") == c) & (F.col("fold") == f)).alias(f"{name}{f}")
            for c, name in ((1, "t"), (0, "o")) for f in (0, 2)
        ]),
        "toxicity-words",
    )


def _dictionaries(counts: DataFrame, folds: tuple[int, ...]) -> Model | None:
    """A model without curve from the words of some folds: those far more frequent in toxic texts
    than chance allows make one dictionary, the commonest others the other."""
    t, o = (sum(F.col(f"{c}{f}") for f in folds) for c in "to")
    counted = counts.select("word", t.alias("t"), o.alias("o"))
    total = counted.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    if not total["t"] or not total["o"]:
        return None
    expected = (F.col("o") + 1) * (total["t"] / total["o"])  # if the word were ordinary
    beyond = expected + SIGMAS * F.sqrt(expected) + LEAST_CONTEXTS
    often = (F.col("t") >= RATIO * expected) & (F.col("t") >= beyond)

    def most(rows: DataFrame, count: str, limit: int) -> list[tuple[bytes, int]]:
        found = rows.orderBy(F.desc(count), "word").limit(limit).select("word", count).collect()
        return [(r["word"].encode(), r[count]) for r in found]

    toxic = most(counted.filter(often), "t", TOXIC_WORDS)
    ordinary = most(counted.filter(~often & (F.col("o") > 0)), "o", ORDINARY_WORDS)
    if not toxic or not ordinary:
        return None
    return Model(_dictionary(toxic, TOXIC_BYTES), _dictionary(ordinary, ORDINARY_BYTES))


def _dictionary(words: list[tuple[bytes, int]], size: int, samples: int = 60_000) -> bytes:
    """A dictionary trained on the words, each as often as it occurs."""
    total = sum(n for _, n in words)
    rows = [b" " + w + b" " for w, n in words for _ in range(max(1, n * samples // max(total, 1)))]
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    try:
        return zstandard.train_dictionary(size, rows, k=20, d=6).as_bytes()
    except zstandard.ZstdError:  # too few words to train on: they are the dictionary
        return b"".join(b" " + w + b" " for w, _ in reversed(words))[-size:]


class _Scorer:
    """Compressors of a model, in one task."""

    def __init__(self, model: Model):
        self.model = model
        self.ordinary = self._compressor(model.ordinary)
        self.both = self._compressor(model.toxic + model.ordinary)

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=self.model.level)
        return zstandard.ZstdCompressor(
            level=self.model.level, dict_data=words, write_content_size=False,
            write_checksum=False, write_dict_id=False,
        )

    @staticmethod
    def _lengths(compressor: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
        done = compressor.multi_compress_to_buffer(windows, threads=1)
        return np.fromiter((len(done[i]) for i in range(len(done))), np.int64, len(windows))

    def savings(self, text: str | None) -> tuple[float, float, int]:
        """The two largest savings, and the number of windows."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        step = self.model.window_words
        best, number = [0, 0], 0
        for at in range(0, len(words), step * 4096):
            part = words[at : at + step * 4096]
            windows = [b" " + b" ".join(part[i : i + step]) + b" " for i in range(0, len(part), step)]
            saved = self._lengths(self.ordinary, windows) - self._lengths(self.both, windows)
            best = sorted([*best, *np.partition(saved, -2)[-2:].tolist()] if len(saved) > 1 else [*best, int(saved[0])])[-2:]
            number += len(windows)
        return float(best[1]), float(best[0]), number


def _features(rows: np.ndarray) -> np.ndarray:
    """Constant, largest and second saving (of at most ``MOST_SAVED``), and the text's length."""
    first, second = np.minimum(rows[:, 0], MOST_SAVED), np.minimum(rows[:, 1], MOST_SAVED)
    return np.column_stack([np.ones(len(rows)), first, second, np.log1p(rows[:, 2])])


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def savings(text: Column | str, model: Model) -> Column:
    """``struct<first, second, windows>`` of a text column."""

    @F.pandas_udf("first double, second double, windows long")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for texts in parts:
            yield pd.DataFrame([scorer.savings(t) for t in texts], columns=["first", "second", "windows"])

    return apply(text)


def score(text: Column | str, model: Model) -> Column:
    """The score (0 to 1) of a text column."""

    @F.pandas_udf("double")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not model.weights:
            for texts in parts:
                yield pd.Series(np.zeros(len(texts)))
            return
        scorer = _Scorer(model)
        weights = np.array(model.weights)
        for texts in parts:
            rows = np.array([scorer.savings(t) for t in texts], float).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(_features(rows) @ weights, -30, 30))))

    return apply(text)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
    label: str = "toxic", sample: int = SAMPLE,
) -> Model:
    """Fit a model on labelled texts whose fold is not 1, at most ``sample`` of a class and fold.

    The dictionaries come from both folds. The curve is fitted on each fold's savings by the
    dictionaries of the other one, weighed with the class sizes of all labels outside fold 1.
    """
    texts = _texts(docs, _labelled(labels, id_col, label, sample), id_col, text)
    counts = _word_counts(texts)
    model = _dictionaries(counts, (0, 2))
    halves = [(unseen, _dictionaries(counts, (known,))) for known, unseen in ((0, 2), (2, 0))]
    release(counts)
    rows = []
    for unseen, half in halves:
        if half is not None:
            seen = texts.filter(F.col("fold") == unseen)
            rows.append(seen.select("toxic", savings("text", half).alias("s")).select("toxic", "s.*").toPandas())
    if model is None or not rows:
        return Model()
    rows = pd.concat(rows)
    y = rows["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model()
    all_rows = labels.filter(fold(id_col) != 1).agg(
        F.count_if(F.col(label) == 1).alias("t"), F.count_if(F.col(label) == 0).alias("o")
    ).first()
    weight = np.where(y == 1, all_rows["t"] / y.sum(), all_rows["o"] / (len(y) - y.sum()))
    x = _features(rows[["first", "second", "windows"]].to_numpy(float))
    model.weights = _fit(x, y, weight / weight.mean()).tolist()
    return model

"""Scores of texts by a backoff automaton of smoothed n-grams, learnt from the training texts.

A text's tokens are its words in lower case and one end. States of the automaton are contexts: the empty
one, words, and, up to ``order - 1`` tokens, longer ones that occur in training. A state has an arc for
every token that follows it in training, with the log probability of the smoothed n-gram, and a failure
arc to the state of the next shorter context, with the log of the share that smoothing leaves to it; the
empty state has an arc for every token, unknown ones included. A text is read once from left to right: the
state is carried, failure arcs are followed until an arc takes the token, and all weights are added up.

Smoothing is hierarchical: ``p(w | context) = (count + k p(w | shorter context)) / (context's count + k)``,
at the bottom half a count more for every token and one unknown; so each state's probabilities add up to
one. The strength ``k`` is, of a few, the one under which every training token is likeliest when left out.

Counts cover all texts and have no limits, so the model grows with the corpus and is never in one place.
Texts are put in blocks of some ``BLOCK_BYTES``. A block asks for the counts of its distinct n-grams, adding
those of its own training texts; questions are sorted hashes in ranges of equal width, so that n-grams meet
by range, each at most once a block, however common. The answers are the counts of all other blocks, mostly
none, in the order of the question.
From them each block builds the part of the automaton that its texts can reach, and reads them.

Blocks are stored in buckets by their ``home``, a few neighbouring blocks, so only answers are shuffled to them.

Memory of a task: a home's blocks, compressed, and one of them with its n-grams; or a range of some ``RANGE_GRAMS``
n-grams plus one for every block that shares its commonest. All steps are tables in the shared folder.

Edge cases: a null or empty text is the end alone; without training texts there is one, unknown, token
with probability 1; null ids and equal rows are scored each; an empty table gives no row. Words are told
apart by 64-bit hashes, longer n-grams by 56 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut, measured_cut, new_path
from .words import chunks, mix, word_hashes

ORDER = 3
STRENGTHS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
BLOCK_BYTES, RANGE_GRAMS = 8 << 20, 4_000_000
#: Blocks that meet their answers together; it divides 2^32.
HOME_BLOCKS = 2
#: Tokens that one lane of a traversal reads.
LANE = 512

_U = np.uint64
#: Hashes of the place before a text and of its end.
_START, _END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
#: Bits by which n-grams of two tokens and more are told apart: of ten billion some 700 share theirs.
_LONG = _U(0xFFFFFFFFFFFFFF00)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, their bytes by significance, compressed."""
    return zstandard.compress(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=_U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=_U)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text after text, ends included, and the number of tokens of each text."""
    parts, sizes = [], []
    for part in chunks(texts):
        words, counts = word_hashes(part)
        parts.append(np.insert(words, np.cumsum(counts), _END))
        sizes.append(counts + 1)
    return np.concatenate(parts), np.concatenate(sizes)


@dataclass
class Grams:
    """The distinct n-grams of one length: their sorted hashes, the number of the one that ends at each
    token (-1: none), and for each the numbers of its context and of the n-gram without its first token.
    The place before a text, as a context, has the number after the last word's."""

    hashes: np.ndarray
    at: np.ndarray
    context: np.ndarray
    shorter: np.ndarray

    def counts(self, where: np.ndarray) -> np.ndarray:
        return np.bincount(self.at[where & (self.at >= 0)], minlength=len(self.hashes)).astype(_U)


def grams_of(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[Grams]:
    """The n-grams of 1 to ``order`` tokens; those at the start of a text begin with the place before it."""
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(tokens)) - np.repeat(begin, sizes)
    out, hashed = [], tokens
    for n in range(1, order + 1):
        if n > 1:
            before = np.concatenate([[_START], hashed[:-1]])
            if n == 2:
                before[begin] = _START
            hashed = mix(before * _U(2 * n - 1) + tokens)
        some = np.flatnonzero(place >= n - 2)
        known_by = hashed[some] & _LONG if n > 1 else hashed[some]
        hashes, first, back = np.unique(known_by, return_index=True, return_inverse=True)
        at = np.full(len(tokens), -1, np.int64)
        at[some] = back
        first = some[first]
        if n == 1:
            context = shorter = np.zeros(len(hashes), np.int64)
        else:
            context, shorter = out[-1].at[first - 1], out[-1].at[first]
            if n == 2:
                context = np.where(place[first] == 0, len(out[0].hashes), context)
        out.append(Grams(hashes, at, context, shorter))
    return out


class Automaton:
    """The states and arcs that some texts can reach. A state is its number of tokens and the number of that
    n-gram; weights have a column for each strength."""

    def __init__(self, grams: list[Grams], counts: list[np.ndarray], n: int, v: int, strengths=STRENGTHS):
        self.grams, self.order, self.k = grams, len(grams), np.array(strengths)
        self.counts = [c.astype(np.float64) for c in counts]
        self.n, self.v = n, v
        self.known = [c > 0 for c in self.counts]
        self.arcs = [np.log10(p, out=p) for p in self._smoothed(0)]
        totals = [self._contexts(m) for m in range(1, self.order)]
        self.failures = [np.log10(self.k / (t[:, None] + self.k)) for t in totals]

    def _contexts(self, m: int) -> np.ndarray:
        """How often tokens follow each context of ``m`` tokens."""
        if m > 1:
            return self.counts[m - 1]
        end = np.flatnonzero(self.grams[0].hashes == _END)  # there is one a text, as there is a start
        return np.append(self.counts[0], self.counts[0][end].sum())

    def _smoothed(self, less: int) -> list[np.ndarray]:
        """Probabilities of all n-grams, each with ``less`` occurrences of its own left out."""
        word = (np.maximum(self.counts[0] - less, 0) + 0.5) / (max(self.n - less, 0) + 0.5 * (self.v + 1))
        out = [np.repeat(word[:, None], len(self.k), 1)]
        for m in range(1, self.order):
            own, total = self.grams[m], self._contexts(m)
            count = np.maximum(self.counts[m] - less, 0)[:, None]
            rest = np.maximum(total[own.context] - less, 0)[:, None]
            out.append((count + self.k * out[m - 1][own.shorter]) / (rest + self.k))
        return out

    def left_out(self, train: np.ndarray) -> np.ndarray:
        """By strength, the sum over training tokens of the log probability without that token's own count."""
        total = np.zeros(len(self.k))
        for m, p in enumerate(self._smoothed(1)):
            longest = self.grams[m + 1].at < 0 if m + 1 < self.order else np.ones(len(train), bool)
            own = self.grams[m].counts(train & longest)
            total += own @ np.log10(p, out=p)
        return total

    def read(self, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, by strength. Texts are read side by side; a long one in lanes,
        each of which first comes to its state by the ``order - 1`` tokens before it."""
        ends = np.cumsum(sizes)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = (ends - sizes)[text] + part * LANE
        skip = np.where(part > 0, self.order - 1, 0)
        length = np.minimum(first + LANE, ends[text]) - first + skip
        lane = np.argsort(-length, kind="stable")
        text, begin, skip, length, part = text[lane], (first - skip)[lane], skip[lane], length[lane], part[lane]
        total = np.zeros((len(lane), len(self.k)))
        # a text begins in the state of the place before it, a later lane in the empty state
        level = np.where(part > 0, 0, min(1, self.order - 1))
        state = np.full(len(lane), len(self.grams[0].hashes))
        active = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
        for i, k in enumerate(active.tolist()):
            at = begin[:k] + i
            level, state, gained = self._step(at, level[:k], state[:k])
            if i < self.order:
                gained[skip[:k] > i] = 0
            total[:k] += gained
        out = np.zeros((len(sizes), len(self.k)))
        np.add.at(out, text, total)
        return out

    def _step(self, at: np.ndarray, level: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take one token in each lane: the next levels and states, and the weights on the way."""
        gained = np.zeros((len(at), len(self.k)))
        level, state, after = level.copy(), state.copy(), np.zeros(len(at), np.int64)
        for m in range(self.order - 1, -1, -1):
            here = np.flatnonzero(level == m)
            gram = self.grams[m].at[at[here]]
            takes = self.known[m][gram] | (m == 0)
            done, left = here[takes], here[~takes]
            gained[done] += self.arcs[m][gram[takes]]
            after[done] = np.minimum(m + self.known[m][gram[takes]], self.order - 1)
            level[done] = -1
            if m:
                gained[left] += self.failures[m - 1][state[left]]
                if m > 1:
                    state[left] = self.grams[m - 1].shorter[state[left]]
                level[left] = m - 1
        for m in range(1, self.order):
            there = after == m
            state[there] = self.grams[m - 1].at[at[there]]
        return after, state, gained


@dataclass
class Block:
    """The tokens of some texts, as they are stored."""

    words: bytes
    places: bytes
    sizes: list[int]
    train: list[bool]

    def grams(self, order: int) -> tuple[list[Grams], np.ndarray, np.ndarray]:
        """The n-grams, the number of tokens of each text, and which tokens are for training."""
        words, places = unpack_sorted(self.words), unpack(self.places)
        sizes = np.array(self.sizes, np.int64)
        return grams_of(words[places.astype(np.int64)], sizes, order), sizes, np.repeat(np.array(self.train, bool), sizes)


def _blocks(docs: DataFrame, id_type: str, block_bytes: int) -> DataFrame:
    """Texts as blocks of tokens: a list of distinct words, and the place of each token in it."""
    id_arrow = to_arrow_type(docs.schema["id"].dataType)
    out = f"block long, ids array<{id_type}>, train array<boolean>, sizes array<long>, words binary, places binary, tokens long, training long"

    def block(number: int, ids: list, train: list[bool], texts: list[str | None]) -> pa.RecordBatch:
        tokens, sizes = tokens_of(texts)
        words, places = np.unique(tokens, return_inverse=True)
        values = [
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_arrow)), pa.array([train], pa.list_(pa.bool_())),
            pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([pack_sorted(words)], pa.binary()),
            pa.array([pack(places.astype(_U))], pa.binary()), pa.array([len(tokens)], pa.int64()),
            pa.array([int(sizes[np.array(train, bool)].sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(values, names=["block", "ids", "train", "sizes", "words", "places", "tokens", "training"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, train, texts, size = [], [], [], 0
        for batch in batches:
            for i, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i), train.append(t), texts.append(text)
                size += 4 * len(text or "") // 3 + 16
                if size >= block_bytes:
                    yield block(number, ids, train, texts)
                    number += 1
                    ids, train, texts, size = [], [], [], 0
        if ids:
            yield block(number, ids, train, texts)

    return docs.select("id", "train", "text").mapInArrow(apply, out)


def _home() -> Column:
    return (F.col("block") - F.pmod("block", F.lit(HOME_BLOCKS))).alias("home")


def _bucketed(blocks: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """The blocks as a table in the shared folder, in buckets by ``home``, and aggregates over its rows."""
    spark, seen = blocks.sparkSession, Observation()
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    watched = blocks.select("*", _home()).observe(seen, *[expr.alias(metric) for metric, expr in metrics.items()])
    watched.write.format("parquet").bucketBy(buckets, "home").option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name), seen.get


def _block_of(row: pa.Table | pa.RecordBatch, k: int = 0) -> Block:
    return Block(*(row[c][k].as_py() for c in ("words", "places", "sizes", "train")))


def _questions(blocks: DataFrame, ranges: int, order: int) -> DataFrame:
    """``(range, block, n, grams, counts)``: the n-grams of a block within a range of hashes, ascending, and
    how often its training texts have them."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grams, _, train = _block_of(batch, k).grams(order)
                for n, own in enumerate(grams, 1):
                    counts = own.counts(train)
                    cuts = np.searchsorted(own.hashes >> _U(32), -(-(np.arange(1, ranges, dtype=np.int64) << 32) // ranges).astype(_U))
                    parts = zip(np.split(own.hashes, cuts), np.split(counts, cuts), strict=True)
                    rows = [(r, pack_sorted(h), pack(c)) for r, (h, c) in enumerate(parts) if len(h)]
                    part, hashes, sums = zip(*rows, strict=True) if rows else ((), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part, pa.int64()), pa.array([batch["block"][k].as_py()] * len(part), pa.int64()),
                            pa.array([n] * len(part), pa.int64()), pa.array(hashes, pa.binary()), pa.array(sums, pa.binary()),
                        ],
                        names=["range", "block", "n", "grams", "counts"],
                    )

    return blocks.select("block", "words", "places", "sizes", "train").mapInArrow(apply, "range long, block long, n long, grams binary, counts binary")


def _answers(questions: DataFrame) -> DataFrame:
    """``(block, range, n, counts, known)``: the counts in the training texts of all other blocks, in the order
    of the question; ``known`` on one row a range is the number of its tokens that training texts have."""

    def apply(rows: pa.Table) -> pa.Table:
        out = []
        for n in sorted(set(rows["n"].to_pylist())):
            asked = rows.filter(pa.compute.equal(rows["n"], n))
            hashes = [unpack_sorted(h.as_py()) for h in asked["grams"]]
            own = np.concatenate([unpack(c.as_py()) for c in asked["counts"]])
            _, back = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.zeros(int(back.max()) + 1, _U)
            np.add.at(total, back, own)
            answers = np.split(total[back] - own, np.cumsum([len(h) for h in hashes])[:-1])
            known = [int((total > 0).sum()) if n == 1 else 0] + [0] * (len(answers) - 1)
            for block, r, answer, k in zip(asked["block"].to_pylist(), asked["range"].to_pylist(), answers, known, strict=True):
                out.append((block, r, n, pack(answer), k))
        names, types = ("block", "range", "n", "counts", "known"), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))

    return questions.groupBy("range").applyInArrow(apply, "block long, range long, n long, counts binary, known long")


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER,
    strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES, range_grams: int = RANGE_GRAMS,
) -> DataFrame:
    """``(id, train, n_tokens, n_known, train_tokens, base_score, score)`` of every row; ``train`` marks those to
    learn from. ``base_score`` is the sum of the empty state's weights alone."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"))
    id_type = read.schema["id"].dataType.simpleString()
    stored = f"score_blocks_{uuid.uuid4().hex}"
    blocks, facts = _bucketed(_blocks(read, id_type, block_bytes), stored, tokens=F.sum("tokens"), training=F.sum("training"))
    n = facts["training"] or 0
    ranges = max(1, order * (facts["tokens"] or 0) // range_grams)
    answers, facts = measured_cut(_answers(_questions(blocks, ranges, order)), "score-answers", known=F.sum("known"))
    v = facts["known"] or 0
    out = f"id {id_type}, train boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>"
    id_arrow = to_arrow_type(read.schema["id"].dataType)

    def scores_of(block: pa.Table, told: pa.Table) -> pa.Table:
        own = _block_of(block)
        grams, sizes, train = own.grams(order)
        by_range = sorted(zip(told["n"].to_pylist(), told["range"].to_pylist(), told["counts"].to_pylist(), strict=True))
        others = [np.concatenate([unpack(c) for m, _, c in by_range if m == k]) for k in range(1, order + 1)]
        counts = [gram.counts(train) + other for gram, other in zip(grams, others, strict=True)]
        automaton = Automaton(grams, counts, n, v, strengths)
        scores, word = automaton.read(sizes), grams[0].at
        begin = np.cumsum(sizes) - sizes
        known = np.add.reduceat(automaton.known[0][word].astype(np.int64), begin)
        base = np.add.reduceat(automaton.arcs[0][word, 0], begin)
        automaton.arcs.clear()  # as large as what is computed next
        left_out = [automaton.left_out(train).tolist()] + [None] * (len(sizes) - 1)
        doubles = pa.list_(pa.float64())
        columns = [
            block["ids"].combine_chunks().flatten().cast(id_arrow), pa.array(own.train, pa.bool_()), pa.array(sizes, pa.int64()),
            pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores.tolist(), doubles), pa.array(left_out, doubles),
        ]
        return pa.table(columns, names=["id", "train", "n_tokens", "n_known", "base_score", "scores", "left_out"])

    def apply(home: pa.Table, told: pa.Table) -> pa.Table:
        return pa.concat_tables(
            scores_of(home.slice(k, 1), told.filter(pa.compute.equal(told["block"], block)))
            for k, block in enumerate(home["block"])
        )

    asked = blocks.select("home", "block", "ids", "words", "places", "sizes", "train")
    met = asked.groupBy("home").cogroup(answers.select("*", _home()).groupBy("home"))
    scored = cut(met.applyInArrow(apply, out), "scores")
    docs.sparkSession.sql(f"DROP TABLE {stored}")  # the files stay as long as those of other steps
    likeliest = scored.select(*[F.sum(F.get("left_out", F.lit(k))) for k in range(len(strengths))]).first()
    best = max(range(len(strengths)), key=lambda k: likeliest[k] or 0.0) if any(likeliest) else 0
    return scored.select(
        "id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score",
        F.get("scores", F.lit(best)).alias("score"),
    )

"""Removal of repeated passages: spans of consecutive sentences that occur before.

A sentence ends with a word that ends in a stop (``.``, ``!``, ``?``, those of other scripts; closing quotes
and brackets may follow) or at a line end. One of more than ``LONG`` words is cut further, by winnowing:
before each word whose checksum is the smallest (the last of equal ones) among some ``WINDOW`` consecutive
words of the sentence. Such cuts follow from ``WINDOW - 1`` words on each side, whatever the language, and
every ``WINDOW`` words hold one. Put together the pieces are the text again.

Every span of consecutive sentences (or pieces) that has ``LEAST`` words, and would not without its first or
without its last one, is hashed by its words, ASCII letters in lower case. Of all places of a span, in the
order of document and position, the first stays; the sentences of every other place go.

A passage of over 50 words that two texts share has such a span in both, wherever it is put in: at either
end at most ``LONG - 1`` words are in a sentence that also holds other words and is short in one of the texts,
or ``WINDOW`` words lie before a common cut. So over 30 words are cut alike, and as a piece has ``LONG`` words at
most, ``LEAST`` words from the first common cut on end among them.

Tasks read texts in lists of some ``CHUNK_BYTES`` and settle what they can: of the places of one span in a list
all but the first go, whatever is elsewhere. Only the first is compared with those of other lists, so a span
that is in every text is shuffled once a list.

Edge cases: null and empty texts have no sentence and stay as they are; equal rows (same id and
text) count as one document and share its result; a null id comes first in the order; rows with
equal id and different texts are told apart by a hash of the text; a span repeated within a text
counts as repeated; text without blanks is cut at line ends only. No input column is touched but the
text, whatever its name. An empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .words import BLANKS, chunks, mix

LONG, WINDOW, LEAST = 11, 10, 21
CHUNK_BYTES = 2 << 20

#: Characters that end a sentence as the last of a word, and those that may follow them.
STOPS = ".!?" + "…。！？।॥؟۔"
CLOSERS = "\"')]}"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))
_GAP = np.zeros(256, bool)
_GAP[list(BLANKS)] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _sentence_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words end a sentence; words lie in ``data`` from ``starts`` to ``ends``."""
    closers = np.zeros(256, bool)
    closers[[ord(c) for c in CLOSERS]] = True
    last = ends - 1
    while True:
        back = closers[data[last]] & (last > starts)
        if not back.any():
            break
        last = last - back
    found = np.zeros(len(starts), bool)
    for stop in STOPS:
        code = stop.encode()
        same = last - starts >= len(code) - 1
        for k, byte in enumerate(reversed(code)):
            same &= data[np.maximum(last - k, 0)] == byte
        found |= same
    lines = np.concatenate([np.zeros(1, np.int32), np.cumsum(data == 10, dtype=np.int32)])
    after = np.append(starts[1:], len(data))
    return found | (lines[after] > lines[ends])


def unit_starts(order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Words that begin a unit: sentences, whose first words ``begins`` marks, and the cuts of long ones.
    ``order`` holds the words' checksums."""
    out = begins.copy()
    n = len(order)
    if n < WINDOW:
        return out
    sentence = np.cumsum(begins) - 1
    long = (np.bincount(sentence) > LONG)[sentence]
    at = np.flatnonzero(long[: n - WINDOW + 1] & (sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :]))
    least, where = order[at], at
    for k in range(1, WINDOW):
        value = order[at + k]
        smaller = value <= least
        least, where = np.where(smaller, value, least), np.where(smaller, at + k, where)
    out[where] = True
    return out


class Units:
    """The units of some texts: the number of words and the first word of each text's units, and the
    hashes of words."""

    def __init__(self, texts: list[bytes]):
        words, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(words)
            words += text.lower().split()
            counts[k] = len(words) - before
        n = len(words)
        order = np.fromiter(map(zlib.crc32, words), np.int64, n)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
        del words
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        gap = _GAP[data]
        self.begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1  # bytes at which words begin, after one blank
        ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        begins = np.concatenate([[True], _sentence_ends(data, self.begin, ends)[:-1]]) if n else np.zeros(0, bool)
        self.text = np.repeat(np.arange(len(texts)), counts)
        begins[1:] |= self.text[1:] != self.text[:-1]
        self.bounds = np.append(np.flatnonzero(unit_starts(order, begins)), n)
        self.first = np.cumsum(counts) - counts  # word at which each text begins
        self.counts = counts

    def spans(self) -> tuple[np.ndarray, ...]:
        """Of all spans: the number of the text, the first unit in it, the number of units, the hash."""
        bounds, n = self.bounds, len(self.hashes)
        if n < LEAST:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
        text = self.text[bounds[:-1]]
        end = (self.first + self.counts)[text]
        forward = np.searchsorted(bounds, bounds[:-1] + LEAST)
        ok = bounds[np.minimum(forward, len(bounds) - 1)] <= end
        ok &= forward < len(bounds)
        start, stop = np.flatnonzero(ok), forward[ok]
        backward = np.searchsorted(bounds, bounds[1:] - LEAST, "right") - 1
        unit = np.arange(1, len(bounds))
        ok = (bounds[1:] >= LEAST) & (bounds[np.maximum(backward, 0)] >= self.first[text])
        ok &= forward[np.maximum(backward, 0)] != unit  # else it is among those before
        start, stop = np.concatenate([start, backward[ok]]), np.concatenate([stop, unit[ok]])
        sums = np.concatenate([[_U(0)], np.cumsum(self.hashes * _powers(_BASE, n), dtype=_U)])
        a, b = bounds[start], bounds[stop]
        hashes = mix((sums[b] - sums[a]) * _powers(_BACK, n)[a] + (b - a).astype(_U))
        text = text[start]
        return text, start - np.searchsorted(bounds, self.first[text]), stop - start, hashes


def units_of(text: str) -> list[str]:
    """The sentences and pieces of one text, each with what follows it; together they are the text."""
    data = text.encode("utf-8", "surrogatepass")
    units = Units([data])
    if not len(units.hashes):
        return [text] if text else []
    cuts = [0, *(units.begin[units.bounds[1:-1]] - 1).tolist(), len(data)]
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(cuts, cuts[1:], strict=False)]


def _local(docs: DataFrame) -> DataFrame:
    """``(span, id, mark, spot, later)`` of ``(id, mark, text)``: the first place of each span in a list of texts,
    and the places that are later than another one of the same list; ``spot`` is the first unit and, in the
    low 8 bits, the number of units."""
    id_type, id_arrow = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)

    def places(ids: list, marks: list[int], texts: list[bytes]) -> pa.RecordBatch:
        text, unit, size, hashes = Units(texts).spans()
        ranks = {key: k for k, key in enumerate(sorted({(i is not None, 0 if i is None else i, m) for i, m in zip(ids, marks, strict=True)}))}
        rank = np.array([ranks[i is not None, 0 if i is None else i, m] for i, m in zip(ids, marks, strict=True)], np.int64)[text]
        spot = unit << 8 | size
        order = np.lexsort((spot, rank, hashes))
        text, rank, spot, hashes = text[order], rank[order], spot[order], hashes[order]
        group = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(order) else np.zeros(0, bool)
        again = np.concatenate([[False], (rank[1:] == rank[:-1]) & (spot[1:] == spot[:-1]) & ~group[1:]]) if len(order) else group
        keep = ~again  # equal rows are one document
        later = ~group[keep]
        text, spot, hashes = text[keep], spot[keep], hashes[keep]
        # what is settled is dealt out evenly
        hashes = np.where(later, mix(hashes + (rank[keep] << 32 | spot).astype(_U) * _BASE), hashes)
        row = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hashes.view(np.int64)), pa.array(ids, id_arrow).take(row), pa.array(marks, pa.int64()).take(row),
                pa.array(spot, pa.int64()), pa.array(later, pa.bool_()),
            ],
            names=["span", "id", "mark", "spot", "later"],
        )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, texts, size = [], [], [], 0
        for batch in batches:
            at = 0
            own, mark = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in chunks((t.as_py() for t in batch.column(2)), CHUNK_BYTES):
                ids += own[at : at + len(part)]
                marks += mark[at : at + len(part)]
                texts += part
                at += len(part)
                size += sum(len(t) + 16 for t in part)
                if size >= CHUNK_BYTES:
                    yield places(ids, marks, texts)
                    ids, marks, texts, size = [], [], [], 0
        if ids:
            yield places(ids, marks, texts)

    return docs.select("id", "mark", "text").mapInArrow(apply, f"span long, id {id_type}, mark long, spot long, later boolean")


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, mark, gone)``: the numbers (from 0) of the sentences and pieces covered by a span that is not the
    first of its kind; ``mark`` is the hash of the text."""
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("mark"), F.col(f"`{text}`").alias("text"))
    # equal rows share the first place, so they have its rank
    place = F.rank().over(Window.partitionBy("span").orderBy("id", "mark", "spot"))
    later = _local(read.filter("length(text) > 0")).withColumn("place", place).filter("later OR place > 1")
    covered = "transform(spots, e -> sequence(int(shiftright(e, 8)), int(shiftright(e, 8) + (e & 255) - 1)))"
    return (
        later.groupBy("id", "mark")
        .agg(F.collect_set("spot").alias("spots"))
        .select("id", "mark", F.sort_array(F.array_distinct(F.flatten(F.expr(covered)))).alias("gone"))
    )


def _without(text: Column, gone: Column) -> Column:
    """Texts without the numbered sentences; null where either is."""

    @F.arrow_udf("string")
    def apply(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, numbers in parts:
            out = []
            for t, g in zip(texts, numbers, strict=True):
                t, g = t.as_py(), g.as_py()
                dropped = set(g or ())
                out.append(None if t is None or g is None else "".join(u for k, u in enumerate(units_of(t)) if k not in dropped))
            yield pa.array(out, pa.string())

    return apply(text, gone)


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not taken, in whatever case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", removed: str | None = None
) -> DataFrame:
    """The documents with their texts without repeated sentences, in the columns they came with;
    ``removed`` names one more column for the numbers (from 0) of the sentences that went."""
    names = {c: fresh([*docs.columns, removed or ""], f"_span_{c}") for c in ("id", "mark", "gone")}
    gone = repeated_sentences(docs, id_col, text)
    gone = gone.select(*[F.col(c).alias(name) for c, name in names.items()])
    own = F.col(f"`{text}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(names["id"])) & (F.xxhash64(own) == F.col(names["mark"]))
    hit = F.col(names["gone"])
    joined = docs.join(gone, same, "left")
    # only texts that lose something go to Python
    left = F.coalesce(_without(F.when(hit.isNotNull(), own), hit), own)
    columns = [left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        columns.append(F.coalesce(hit, F.array().cast("array<int>")).alias(removed))
    return joined.select(*columns)

"""Packing token ids into sequences of fixed length, with a bounded number of open windows.

Each task goes through its texts once and keeps at most ``windows`` open. A text's ids, cut into
whole sequences as long as they fill one, leave a rest that goes to the open window it fits best.
When it fits none, the fullest window is filled up with the head of the rest, emitted, and the
rest goes on. What is open at the end of a task is merged: the leftovers of many tasks are packed
again by fewer, until one task has little enough; there the last, unfilled sequence is cut into
powers of two. So nothing is padded.

Memory of a task: the open windows, one text, and a bounded table of known words. Outputs of a
round are written to the shared folder, so a lost task repeats only its own part.

Edge cases: a null or empty text has the end id alone; a text longer than a sequence spans several;
equal rows are packed each; an empty table gives no piece; of the input only id and text are read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import measured_cut
from .words import mix

LENGTH, WINDOWS, END_ID = 2048, 64, 1
KNOWN_PIECES = 300_000

#: Fixed value: the pattern of the vocabulary whose pieces are cut here.
FIXED_PATTERN = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Leftover tokens that one task may merge.
MERGE_TOKENS = 8 * WINDOWS * LENGTH

#: Texts that need the library's own normaliser, or its special tokens.
OTHER = re.compile("[^\x00-\xff]|<\\|")
#: Characters cut into pieces at once; that takes some 70 bytes each.
CHUNK_CHARS = 1 << 18

_BLANK, _LETTER, _DIGIT, _SIGN = range(4)


def _classes() -> np.ndarray:
    """Class of each Latin-1 character, as the vocabulary's pattern sees it."""
    kinds = {"L": _LETTER, "N": _DIGIT}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _SIGN) for c in range(256)], np.uint8)
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _BLANK
    return out


_CLASS = _classes()
_NUMBER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)


def _pieces(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of lower-case Latin-1 text start and end: runs of letters, single digits,
    runs of signs, and the endings ``'s 't 're 've 'm 'll 'd``."""
    data = np.frombuffer(b" " + text + b"    ", np.uint8)
    kind = _CLASS[data]
    start = (kind[1:] != _BLANK) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    start = np.concatenate([[False], start])
    mark = np.flatnonzero(start[:-3] & (data[:-3] == ord("'")))
    if len(mark):
        one = np.isin(data[mark + 1], np.frombuffer(b"stmd", np.uint8))
        pair = data[mark + 1].astype(np.uint16) << 8 | data[mark + 2]
        two = ~one & np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        for cut_at, found in ((2, mark[one]), (3, mark[two])):
            start[found + 1] = False
            start[found + cut_at] = kind[found + cut_at] != _BLANK
    starts = np.flatnonzero(start)
    blank = np.flatnonzero(kind == _BLANK)
    ends = np.minimum(
        np.append(starts[1:], len(data)), blank[np.searchsorted(blank, starts)]
    )
    return starts - 1, ends - 1


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The vocabulary works on pieces of text (words, digits, signs), each by itself. So many texts
    are cut into pieces at once, and only pieces not met before go through the model. Texts
    outside Latin-1 go through the library whole. Pieces are told apart by 64-bit hashes.
    """

    def __init__(self, file: str, known_pieces: int = KNOWN_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        rules = self.tokenizer.to_str().split('"model"', 1)[0]  # without the vocabulary
        # cutting here is right for this normaliser and pattern only
        kinds = re.findall(r'"type":"(\w+)"', rules.split('"pre_tokenizer"')[0].split('"normalizer":')[-1])
        self.by_piece = kinds == ["Sequence", "NFC", "Replace", "Lowercase"] and FIXED_PATTERN in rules
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.chars = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)} if self.by_piece else {}
        self.most = known_pieces
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.at = array("I"), array("q", [0])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        part, size = [], 0
        for i, text in enumerate(texts):
            if not self.by_piece or OTHER.search(text):
                out[i] = self.whole(text)
                continue
            part.append(i)
            size += len(text)
            if size >= CHUNK_CHARS:
                self._some(texts, part, out)
                part, size = [], 0
        self._some(texts, part, out)
        return out

    def _some(self, texts: list[str], which: list[int], out: list) -> None:
        if not which:
            return
        # texts are apart by a blank, so no piece spans two
        lower = [texts[i].lower().encode("latin-1") for i in which]
        joined = b" ".join(lower)
        starts, ends = _pieces(joined)
        bounds = np.cumsum([len(t) + 1 for t in lower])
        if not len(starts):
            for i in which:
                out[i] = b""
            return
        data = np.frombuffer(joined, np.uint8)
        size = ends - starts
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        powers = np.full(int(size.max()), _BASE)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        values = _NUMBER[data[np.repeat(starts, size) + place]] * powers[place]
        hashes = mix(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64))
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._forget()
        rows = self._rows(unique.tolist(), joined, starts[first], ends[first])
        at = np.frombuffer(self.at, np.int64)
        ids = np.frombuffer(self.ids, np.uint32)
        row = rows[back]
        n = at[row + 1] - at[row]
        total = np.cumsum(n)
        found = ids[np.repeat(at[row] - (total - n), n) + np.arange(int(total[-1]))].astype("<u4")
        last = np.concatenate([[0], total])[np.searchsorted(starts, bounds)]
        begin = 0
        for i, end in zip(which, last.tolist(), strict=True):
            out[i] = found[begin:end].tobytes()
            begin = end
        del at, ids  # they hold the arrays, which grow

    def _rows(self, hashes: list[int], joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        rows = np.fromiter((self.known.get(h, -1) for h in hashes), np.int64, len(hashes))
        model, known = self.tokenizer.model, self.known
        for i in np.flatnonzero(rows < 0).tolist():
            piece = joined[starts[i] : ends[i]].decode("latin-1").translate(self.chars)
            self.ids.extend([t.id for t in model.tokenize(piece)])
            rows[i] = known[hashes[i]] = len(self.at) - 1
            self.at.append(len(self.ids))
        return rows


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The encoder of this Python worker: what it knows serves the next task too."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


@dataclass
class _Window:
    used: int = 0
    pieces: list[tuple] = field(default_factory=list)


class _Packer:
    """The open windows of one task. A piece is (row, start, ids); rows of the result are (row,
    start, ids, sequence, offset, whether the sequence is done)."""

    def __init__(self, length: int, windows: int, first: int):
        self.length, self.most, self.next = length, windows, first
        self.open: list[_Window] = []

    def _emit(self, pieces: list[tuple], done: bool = True) -> Iterator[tuple]:
        at = 0
        for row, start, ids in pieces:
            yield row, start, ids, self.next, at, done
            at += len(ids) // 4
        self.next += 1

    def add(self, row: tuple, start: int, ids: bytes) -> Iterator[tuple]:
        whole = 4 * self.length
        at = 0
        while len(ids) - at >= whole:
            yield from self._emit([(row, start + at // 4, ids[at : at + whole])])
            at += whole
        while at < len(ids):
            need = (len(ids) - at) // 4
            fits = [w for w in self.open if w.used + need <= self.length]
            if fits:
                best = max(fits, key=lambda w: w.used)
            elif len(self.open) < self.most:
                best = _Window()
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w.used)
            take = min(need, self.length - best.used)
            best.pieces.append((row, start + at // 4, ids[at : at + 4 * take]))
            best.used += take
            at += 4 * take
            if best.used == self.length:
                self.open.remove(best)
                yield from self._emit(best.pieces)

    def leftovers(self) -> Iterator[tuple]:
        for window in self.open:
            yield from self._emit(window.pieces, False)
        self.open = []

    def merge(self) -> Iterator[tuple]:
        """Put what is open together; the last sequence is cut into powers of two."""
        rest = [p for w in self.open for p in w.pieces]
        self.open = []
        left = sum(len(ids) // 4 for _, _, ids in rest)
        space, row = 0, []
        for doc, start, ids in rest:
            at = 0
            while at < len(ids):
                if not space:
                    space = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                    left -= space
                take = min(space, len(ids) // 4 - at // 4)
                row.append((doc, start + at // 4, ids[at : at + 4 * take]))
                at += 4 * take
                space -= take
                if not space:
                    yield from self._emit(row)
                    row = []


_FIELDS = ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_())


def _batches(rows: Iterable[tuple], id_type: pa.DataType, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", id_type), *_FIELDS])

    def batch(part: list[tuple]) -> pa.RecordBatch:
        values = [
            [r[0][0] for r in part], [r[1] for r in part], [len(r[2]) // 4 for r in part], [r[2] for r in part],
            [r[0][1] for r in part], [r[3] for r in part], [r[4] for r in part], [r[5] for r in part],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[2]) + 64
        if size >= most:
            yield batch(part)
            part, size = [], 0
    if part:
        yield batch(part)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
    length: int = LENGTH, windows: int = WINDOWS, end_id: int = END_ID, merge_tokens: int = MERGE_TOKENS,
) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: one row per piece; ``ids``
    are little-endian unsigned 32-bit numbers. ``tokenizer`` is a file that all executors have."""
    end = np.array([end_id], "<u4").tobytes()
    id_arrow = to_arrow_type(docs.schema[id_col].dataType)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, done boolean"

    def first_id(level: int) -> int:
        return (level << 56) | (TaskContext.get().partitionId() << 32)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(tokenizer), _Packer(length, windows, first_id(0))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                docs = batch.column(0).to_pylist()
                encoded = own.many([t or "" for t in batch.column(1).to_pylist()])
                for doc, ids in zip(docs, encoded, strict=True):
                    ids += end
                    yield from packer.add((doc, len(ids) // 4), 0, ids)
            yield from packer.leftovers()

        yield from _batches(rows(), id_arrow)

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = _Packer(length, windows, first_id(level))

            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for doc, start, ids, total in zip(*batch.columns, strict=True):
                        yield from packer.add((doc.as_py(), total.as_py()), start.as_py(), ids.as_py())
                yield from packer.merge() if last else packer.leftovers()

            yield from _batches(rows(), id_arrow)

        return run

    rest = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(texts, out)
    result, level = None, 0
    while True:
        kept, facts = measured_cut(
            rest, f"packed-{level}", left=F.sum(F.when(F.col("done"), 0).otherwise(F.col("length")))
        )
        done = kept.filter("done").drop("done")
        result = done if result is None else result.unionByName(done)
        left = facts["left"] or 0
        if not left:
            return result
        level += 1
        tasks = max(1, left // merge_tokens)
        open_pieces = kept.filter("NOT done").select("doc_id", "start", "ids", "doc_tokens")
        rest = open_pieces.coalesce(int(tasks)).mapInArrow(again(level, tasks == 1), out)


"""Periodic runs of words: maximal stretches that repeat a period several times.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) and at least
``least`` words and ``power`` periods that no neighbouring word extends with the same period. The
method for one text: Ukkonen's suffix trees of the words and of their reversal; a depth-first (Euler)
tour of each with a table of range minima answers in constant time how far two places agree to the
right and to the left. Every run holds a Lyndon root, in the order of the words or in the reverse one,
that is the longest Lyndon word from its place on; these follow from the ranks of the suffixes. So each
place gives two candidates, which are extended both ways; all but the trees is done on arrays.

Trees are only built where a run can be: a run is covered by windows of ``least - least // power``
words that occur in it twice, one period apart. Windows are hashed, and what repeated windows cover
without a gap is a segment; runs lie whole in one, and a segment without a window repeated within
itself has none. Equal hashes of different words only cost a tree in vain.

Memory of a task: one list of texts of some ``CHUNK_BYTES``, or one text, and one tree of the longest
segment (some 400 bytes a word). No task sees more than its own texts, so a lost one costs only itself.

Edge cases: a null or empty text has no words, no runs and the empty text left; equal rows give equal
results; a text that is one run keeps its first period; there is no limit on words, periods or runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import chunks, mix, word_hashes

LEAST, POWER = 24, 3
_U = np.uint64


class SuffixTree:
    """Ukkonen's suffix tree of numbers below ``sigma``, of which the last is 0 and occurs once.
    ``rank`` is the place of each suffix in order; ``agree`` how many numbers two suffixes share."""

    def __init__(self, s: list[int], sigma: int):
        n = len(s)
        # nodes: where the label starts and ends, suffix link, depth in numbers (of inner nodes), suffix (of leaves)
        begin, end, link, depth, suffix = [0], [0], [0], [0], [-1]
        edges: dict[int, int] = {}
        node = at = length = open_suffixes = leaves = 0
        for i, c in enumerate(s):
            open_suffixes += 1
            inner = 0
            while open_suffixes:
                if not length:
                    at = i
                key = node * sigma + s[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begin)
                    begin.append(i), end.append(n), link.append(0), depth.append(0), suffix.append(leaves)
                    leaves += 1
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    first = begin[child]
                    size = end[child] - first
                    if length >= size and suffix[child] < 0:
                        at += size
                        length -= size
                        node = child
                        continue
                    other = s[first + length]
                    if other == c:
                        if inner:
                            link[inner] = node
                        length += 1
                        break
                    new = len(begin)
                    edges[key] = new
                    begin.append(first), end.append(first + length), link.append(0)
                    depth.append(depth[node] + length), suffix.append(-1)
                    begin[child] = first + length
                    edges[new * sigma + other] = child
                    edges[new * sigma + c] = new + 1
                    begin.append(i), end.append(n), link.append(0), depth.append(0), suffix.append(leaves)
                    leaves += 1
                    if inner:
                        link[inner] = new
                    inner = new
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - open_suffixes + 1
        del begin, end, link
        self._tour(edges, sigma, depth, suffix, n)

    def _tour(self, edges: dict[int, int], sigma: int, depth: list[int], suffix: list[int], n: int) -> None:
        """Go round the tree: leaves in order, and the depth at which the way turns between two."""
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)[::-1]  # the last child is put on the stack first
        parents = keys[order] // sigma
        children = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        edges.clear()
        nodes = np.arange(len(suffix))
        lows = np.searchsorted(-parents, -nodes, "left").tolist()
        highs = np.searchsorted(-parents, -nodes, "right").tolist()
        ranked, turns, stack, above, turn = [], [], [0], [0], False
        while stack:
            node, up = stack.pop(), above.pop()
            if turn:
                turns.append(up)
                turn = False
            if suffix[node] >= 0:
                ranked.append(suffix[node])
                turn = True
            else:
                part = children[lows[node] : highs[node]]
                stack += part
                above += [depth[node]] * len(part)
        self.rank = np.empty(n, np.int32)
        self.rank[ranked] = np.arange(n, dtype=np.int32)
        level = np.array(turns or [0], np.int32)
        self.minima = [level]
        width = 1
        while 2 * width <= len(level):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes at ``a`` and ``b``, never the same, have in common."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            some = level == k
            table = self.minima[k]
            out[some] = np.minimum(table[low[some]], table[high[some] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """The next place with a smaller rank; the last place has none."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(words: list, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period."""
    numbers: dict = {}
    s = [numbers.setdefault(w, len(numbers) + 1) for w in words]
    n, sigma = len(s), len(numbers) + 1
    if n < least:
        return []
    tree = SuffixTree([*s, 0], sigma)
    rank = tree.rank.tolist()
    root = np.arange(n)
    places, nexts = [], []
    # under the reverse order of words the ranks are the other way round
    for order in (rank, [-r for r in rank]):
        after = np.minimum(np.array(_next_smaller(order)[:n]), n)
        places.append(root)
        nexts.append(after)
    del rank
    at, after = np.concatenate(places), np.concatenate(nexts)
    right = tree.agree(at, after)
    del tree
    back = SuffixTree([*reversed(s), 0], sigma)
    left = back.agree(n - at, n - after)
    period, start, size = after - at, at - left, right + left + after - at
    good = (size >= least) & (size >= power * period)
    found: dict[tuple[int, int], int] = {}
    for a, m, p in zip(start[good].tolist(), size[good].tolist(), period[good].tolist(), strict=True):
        found[a, m] = min(p, found.get((a, m), p))
    return sorted(((a, m, p) for (a, m), p in found.items()), key=lambda r: (r[0], r[2]))


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, from windows of half the size."""
    if size == 1:
        return hashes
    half = size // 2
    first, rest = _windows(hashes, half), _windows(hashes, size - half)
    n = len(hashes) - size + 1
    return mix(first[:n] * _U(3) + rest[half : half + n] + _U(size))


def segments(hashes: np.ndarray, text: np.ndarray, least: int = LEAST, power: int = POWER) -> Iterator[tuple[int, int]]:
    """Stretches of words, from and to, that hold all runs; ``text`` is the number of each word's text."""
    size = least - least // power
    if len(hashes) < least:
        return
    windows = _windows(hashes, size)
    part, alive = text, np.flatnonzero(text[: len(windows)] == text[size - 1 :])
    for _ in range(2):  # repeated in the text, then in the segment
        keys = mix(windows[alive] + part[alive].astype(_U) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        repeated = np.zeros(len(alive), bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        alive = alive[repeated]
        if not len(alive):
            return
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, alive, 1)
        np.add.at(cover, alive + size, -1)
        covered = np.cumsum(cover[:-1]) > 0
        begins = covered & ~np.concatenate([[False], covered[:-1] & (text[1:] == text[:-1])])
        part = np.cumsum(begins)
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(covered & ~np.concatenate([covered[1:] & ~begins[1:], [False]])) + 1
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= least:
            yield a, b


def find(texts: list[bytes], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    hashes, counts = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    known, words = -1, []
    for a, b in segments(hashes, text, least, power):
        t = int(text[a])
        if t != known:
            known, words = t, texts[t].split()
        shift = a - int(first[t])
        out[t] += [(shift + s, m, p) for s, m, p in runs_of(words[shift : shift + b - a], least, power)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by blanks, without those that any run holds after its first period."""
    words = text.split()
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, size, period in runs:
            gone[start + period] += 1
            gone[start + size] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
    return b" ".join(words)


RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def collapse(text: Column | str, least: int = LEAST, power: int = POWER) -> Column:
    """A struct of the ``runs`` of a text column, by start, then period, and the ``collapsed`` text: its
    words joined by blanks, of each run only the first period."""
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @F.arrow_udf(RESULT)
    def apply(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found, left = [], []
            for part in chunks(t.as_py() for t in texts):
                each = find(part, least, power)
                found += [[{"start": s, "length": m, "period": p} for s, m, p in r] for r in each]
                left += [collapsed(t, r).decode("utf-8", "surrogatepass") for t, r in zip(part, each, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(found, run), pa.array(left, pa.string())], ["runs", "collapsed"])

    return apply(text)

"""Hashes of words and of runs of words, many texts at a time, for use inside Spark tasks.

A word is a run of bytes other than space and ``\\x09``-``\\x0D``; ``A``-``Z`` count as lower case.
Every byte has a 64-bit number of its own, a word is a polynomial over these numbers, and a
run of words is a polynomial over the mixed hashes of its words, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

RUN = 5
CHUNK_BYTES = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(20240229).integers(1, 2**63, RUN, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: Bytes between words.
BLANKS = frozenset([0x20, *range(0x09, 0x0E)])
#: Bytes between words that are runs of ASCII letters, digits and anything beyond ASCII.
SIGNS = frozenset([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@cache
def _byte_table(gaps: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    numbers[ord("A") : ord("Z") + 1] = numbers[ord("a") : ord("z") + 1]
    gap = np.zeros(256, bool)
    gap[list(gaps)] = True
    numbers[gap] = 0
    return numbers, gap


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The texts as bytes, in lists of some ``limit`` bytes; null is empty."""
    part, size = [], 0
    for text in texts:
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        part.append(data)
        size += len(data) + 1
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_hashes(texts: list[bytes], gaps: frozenset[int] = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and the number of words of each text."""
    numbers, is_gap = _byte_table(gaps)
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    gap = is_gap[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes) + 1  # where the next text begins
    counts = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    place = np.arange(len(data)) - np.repeat(
        np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]]))
    )
    longest = int(np.where(gap, 0, place).max()) + 1
    powers = np.full(longest, _BASE | _U(1))
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    place[gap] = 0  # a gap counts 0 whatever its weight
    sums = np.add.reduceat(numbers[data] * powers[place], starts)
    return mix(sums), counts


def run_hashes(words: np.ndarray, counts: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``run`` words, text after text and in order, and their number by text.
    A text with fewer words, but some, is one run."""
    first = np.cumsum(counts) - counts
    n = np.maximum(counts - run + 1, np.minimum(counts, 1))
    total = int(n.sum())
    if not total:
        return np.empty(0, np.uint64), n
    text = np.repeat(np.arange(len(counts)), n)
    start = first[text] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(counts, run)[text]
    out = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(run, np.uint64)])
    for k in range(run):
        word = padded[start + k]
        out += np.where(k < size, word, _U(0)) * _STEPS[k]
    return mix(out), n


def split(values: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """The part of ``values`` of each text."""
    at = 0
    for n in counts:
        yield values[at : at + n]
        at += n


def shingle_sets(texts: Iterable[str | None], run: int = RUN) -> Iterator[np.ndarray]:
    """The sorted, distinct run hashes of each text."""
    for part in chunks(texts):
        for values in split(*run_hashes(*word_hashes(part), run)):
            yield np.unique(values)

"""Licence notices by template: token automata that accept the wording a template demands.

A template is a line of words with markup: ``[ ... ]`` may be missing, ``{m,n}`` stands for ``m`` to
``n`` words of any kind, ``{a|b}`` for one of the words. It is compiled to an automaton over
words: states are places in the template, an optional region is a way around it, a replaceable
region a row of states that take any word. A text is accepted where its words, from some place on,
lead to the end; all other wording has to match word for word.

Words are runs of ``0-9``, letters and whatever is beyond ASCII, ``A-Z`` in lower case, compared
by 64-bit hashes. Only places that a template can begin at are tried, in texts that have all the
words it demands; a trial is as long as the template at most.

Edge cases: null and empty texts have no words and no labels; phrases and notices are found
anywhere in texts of any length; equal texts have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import SIGNS, chunks, word_hashes

#: Phrases and the labels they stand for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "apache-2.0": "[this {work|software|file|text} is] {licensed|released|distributed} under [the terms of] the apache license [version] 2 0",
    "mit": "[this {work|software|file|text} is] {licensed|released|distributed} under [the terms of] the mit license",
    "cc-by-4.0": "{licensed|released|distributed} under [a|the] [creative commons] cc by 4 0 [international]",
    "cc-by-sa-4.0": "{licensed|released|distributed} under [a|the] [creative commons] cc by sa 4 0 [international]",
    "cc-by-nc-4.0": "{licensed|released|distributed} under [a|the] [creative commons] cc by nc 4 0 [international]",
    "gpl-3.0": "{licensed|released|distributed} under [the terms of] the gnu general public license [version|v] 3 [0] [or {any|a} later version]",
    "copyright": "copyright [c] {1,8} all rights reserved",
}


@dataclass
class Automaton:
    """``steps[s]``: ``(word, next state)``, a word of None being any; ``free[s]``: states reached
    without a word. State 0 begins, ``end`` accepts; ``demanded``: words no path goes without."""

    steps: list[list[tuple[str | None, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    end: int = 0
    demanded: set[str] = field(default_factory=set)

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


def compile_template(template: str) -> Automaton:
    """The automaton of a template. ``[a|b]`` is short for ``[{a|b}]``."""
    auto = Automaton()
    at = auto.state()
    opened: list[int] = []
    for part in template.replace("[", " [ ").replace("]", " ] ").split():
        if part == "[":
            opened.append(at)
        elif part == "]":
            auto.free[opened.pop()].append(at)
            # what follows must not run back into the region
            after = auto.state()
            auto.free[at].append(after)
            at = after
        elif part[0] == "{" and "," in part:
            low, high = (int(n) for n in part[1:-1].split(","))
            ways = [at]
            for _ in range(high):
                after = auto.state()
                auto.steps[at].append((None, after))
                at = after
                ways.append(at)
            for way in ways[low:-1]:
                auto.free[way].append(at)
        else:
            after = auto.state()
            words = part.strip("{}").split("|")
            auto.steps[at] += [(w, after) for w in words]
            if len(words) == 1 and not opened:
                auto.demanded.add(part)
            at = after
    if opened:
        raise ValueError(f"a region of the template does not end: {template}")
    auto.end = at
    return auto


def _hash(word: str) -> int:
    return int(word_hashes([word.encode()], SIGNS)[0][0])


class Scanner:
    """Phrases and templates over hashed words, in one task."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(label, word_hashes([p.encode()], SIGNS)[0]) for p, label in phrases.items()]
        self.templates = []
        words: set[int] = set()
        for label, template in templates.items():
            auto = compile_template(template)
            steps = [[(None if w is None else _hash(w), s) for w, s in row] for row in auto.steps]
            closure = [auto.closure({s}) for s in range(len(steps))]
            first = {w for s in closure[0] for w, _ in steps[s]}
            demanded = np.array(sorted(_hash(w) for w in auto.demanded), np.uint64)
            words |= {int(w) for w in demanded}
            self.templates.append((label, steps, closure, auto.end, first, demanded))
        self.words = np.array(sorted(words), np.uint64)

    def _accepts(self, words: list[int], at: int, steps, closure, end: int) -> bool:
        states = closure[0]
        while True:
            if end in states:
                return True
            if at >= len(words):
                return False
            word, after = words[at], set()
            for s in states:
                for w, to in steps[s]:
                    if w is None or w == word:
                        after |= closure[to]
            if not after:
                return False
            states, at = after, at + 1

    def labels(self, words: np.ndarray) -> list[str]:
        """Templates that accept the words from some place on."""
        out, present, listed = [], None, None
        for label, steps, closure, end, first, demanded in self.templates:
            if present is None:
                present = np.unique(words)
            if not np.isin(demanded, present).all():
                continue
            begin = np.arange(len(words)) if None in first else np.flatnonzero(np.isin(words, np.array(list(first), np.uint64)))
            listed = words.tolist() if listed is None else listed
            if any(self._accepts(listed, at, steps, closure, end) for at in begin.tolist()):
                out.append(label)
        return out

    def scan(self, texts: list[bytes]) -> Iterator[tuple]:
        words, counts = word_hashes(texts, SIGNS)
        ends = np.cumsum(counts)
        starts = ends - counts
        last = np.repeat(ends, counts)
        found: dict[int, list] = {}
        for label, phrase in self.phrases:
            n = len(phrase)
            hits = np.flatnonzero(words == phrase[0])
            hits = hits[hits + n <= last[hits]] if len(hits) else hits
            for k in range(1, n):
                hits = hits[words[hits + k] == phrase[k]]
            for at in hits.tolist():
                text = int(np.searchsorted(ends, at, "right"))
                found.setdefault(text, []).append((at - int(starts[text]), label))
        # texts with at least one word that some template demands
        known = np.flatnonzero(np.isin(words, self.words))
        maybe = set(np.searchsorted(ends, known, "right").tolist())
        for i in range(len(texts)):
            places = found.get(i, [])
            base = sorted({label for _, label in places})
            more = self.labels(words[starts[i] : ends[i]]) if i in maybe else []
            at = [p for p, _ in places]
            score = 1.0 if more else 0.5 if base else 0.0
            yield (
                int(counts[i]), len(places), min(at, default=None), max(at, default=None),
                ",".join(base), ",".join(sorted({*base, *more})), score,
            )


_FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def licences(
    text: Column | str, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None
) -> Column:
    """``struct<n_words, n_base, first_word, last_word, base_labels, labels, score>`` of a text.
    The score is 1 where a template accepts, 0.5 where only a phrase is found, else 0."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        for texts in parts:
            rows = [row for part in chunks(texts) for row in scanner.scan(part)]
            frame = pd.DataFrame(rows, columns=_FIELDS)
            frame[["first_word", "last_word"]] = frame[["first_word", "last_word"]].astype("Int64")
            yield frame

    return apply(text)

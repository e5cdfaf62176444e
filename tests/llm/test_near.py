"""Jaccard join, fingerprints and sentence spans against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import fingerprints, jaccard, spans


def runs(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(rows):
    """Smallest id by links, of rows (id, text)."""
    sets = [runs(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    known = [x for x in (label[a], label[b]) if x is not None]
                    label[a] = label[b] = min(known)
                    changed = True
    return [(i, len(s), c) for (i, _), s, c in zip(rows, sets, label, strict=True)]


@pytest.mark.parametrize(("common", "tile"), [(64, 1024), (2, 3), (1, 1)])
def test_jaccard_components(spark, some_docs, common, tile):
    docs = spark.createDataFrame(some_docs, "doc_id long, text string").repartition(5)
    found = jaccard.near_duplicates(docs, common=common, tile=tile).select("id", "n", "component").collect()
    assert Counter(map(tuple, found)) == Counter(components(some_docs))


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = jaccard.near_duplicates(odd_docs).select("id", "n", "component").collect()
    assert Counter(map(tuple, found)) == Counter(components(rows))
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_bitmap_never_hides_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, int(rng.integers(0, 90)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 175 * both >= 75 * (len(a) + len(b)):
            assert jaccard.may_link(jaccard.bitmap(a), jaccard.bitmap(b), len(a) + len(b), 75)


def test_fingerprints_estimate_likeness(spark, some_docs):
    docs = spark.createDataFrame(some_docs, "doc_id long, text string").repartition(7)
    rows = {r["id"]: r for r in fingerprints.with_next(docs).collect()}
    texts = dict(some_docs)
    order = sorted(texts)
    errors = []
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % len(order)]]
        changed = texts[i][: len(texts[i]) - len(texts[i]) // 4] + after[: len(texts[i]) // 4]
        assert rows[i]["n_chars"] == len(texts[i])
        assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for other, got in ((changed, "near_edited"), (after, "near_next")):
            a, b = runs(texts[i]), runs(other)
            errors.append(rows[i][got] - len(a & b) / len(a | b))
    assert np.sqrt(np.mean(np.square(errors))) < 0.04
    assert abs(np.mean(errors)) < 0.02
    same = [list(fingerprints.sketches([t]))[0] for t in texts.values()]
    assert len(set(same)) == len({frozenset(runs(t)) for t in texts.values()})


def test_fingerprints_odd_rows(spark, odd_docs, no_docs):
    rows = fingerprints.with_next(odd_docs).collect()
    assert sorted((r["id"] or -1, r["n_chars"]) for r in rows) == sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in odd_docs.collect())
    empty = [r for r in rows if r["n_chars"] == 0]
    assert {bytes(r["fingerprint"]) for r in empty} == {b""}
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert fingerprints.with_next(no_docs).count() == 0
    alone = fingerprints.with_next(odd_docs.filter("doc_id = 13")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1
    assert fingerprints.fingerprint(odd_docs, "text", "print").count() == odd_docs.count()


def pieces(text):
    """Sentences by stops and line ends; those of more than 11 words also start anew before the last smallest
    checksum of any 10 words."""
    found = re.findall(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", text or "")
    lead = re.match(r"[\x20\x09-\x0D]*", text or "")[0]
    sentences = [[]]
    for word, blanks in found:
        sentences[-1].append((word, blanks))
        bare = word
        while len(bare) > 1 and bare[-1] in "\"')]}":
            bare = bare[:-1]
        if bare[-1] in ".!?…。！？।॥؟۔" or "\n" in blanks:
            sentences.append([])
    out = []
    for sentence in sentences:
        starts = {0}
        if len(sentence) > 11:
            sums = [zlib.crc32(w.encode().lower()) for w, _ in sentence]
            starts |= {max(range(i, i + 10), key=lambda k: (-sums[k], k)) for i in range(len(sums) - 9)}
        for a, b in zip(sorted(starts), [*sorted(starts)[1:], len(sentence)], strict=True):
            out.append(sentence[a:b])
    out = [u for u in out if u]
    texts = ["".join(w + x for w, x in u) for u in out]
    if texts:
        texts[0] = lead + texts[0]
    return texts, [[w.encode().lower() for w, _ in u] for u in out]


def cut_repeats(rows):
    """Texts without the pieces of spans of at least 21 words that occur before."""
    parts = {k: pieces(t) for k, (_, t) in enumerate(rows)}
    order = sorted(parts, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    first, gone = {}, {k: set() for k in parts}
    for k in order:
        words = parts[k][1]
        for at in range(len(words)):
            for end in range(at + 1, len(words) + 1):
                n = sum(map(len, words[at:end]))
                if n >= 21:
                    # all spans that grow no shorter by one piece at either end
                    if n - len(words[at]) < 21 or n - len(words[end - 1]) < 21:
                        run = (*sum(words[at:end], []),)
                        # equal rows are one document
                        if first.setdefault(run, (rows[k], at, end)) != (rows[k], at, end):
                            gone[k].update(range(at, end))
                    if n - len(words[at]) >= 21:
                        break
    return [(rows[k][0], "".join(s for at, s in enumerate(parts[k][0]) if at not in gone[k]) if gone[k] else rows[k][1], sorted(gone[k])) for k in parts]


def test_spans(spark, some_docs):
    some_docs = [*some_docs, (500, "A! B! C? " * 9), (501, "New one. " + "A! B! C? " * 8 + "Q! " * 3)]
    docs = spark.createDataFrame(some_docs, "doc_id long, text string").repartition(6)
    found = spans.remove_repeats(docs, removed="gone").select("doc_id", "text", "gone").collect()
    assert sorted(map(tuple, found)) == sorted(cut_repeats(some_docs))
    assert {r["text"] for r in found if r["doc_id"] == 501} == {"New one. " + "Q! " * 3}
    assert sum(bool(r["gone"]) for r in found) > 25


def test_spans_in_short_lists(spark, some_docs, monkeypatch):
    """What lists settle by themselves and what they leave to the others."""
    docs = spark.createDataFrame(some_docs, "doc_id long, text string")
    monkeypatch.setattr(spans, "CHUNK_BYTES", 1500)
    own = spans._local(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")).filter("NOT later")
    assert own.groupBy("span").count().filter("count > 1").count() > 10
    found = spans.remove_repeats(docs, removed="gone").select("doc_id", "text", "gone").collect()
    assert sorted(map(tuple, found)) == sorted(cut_repeats(some_docs))


def test_spans_odd_rows(spark, odd_docs, no_docs):
    out = spans.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    before = {r["n"]: r for r in odd_docs.collect()}
    after = {r["n"]: r for r in out.collect()}
    assert before.keys() == after.keys()
    assert after[2]["text"] == after[3]["text"] == ""  # equal rows are one document, after id 1
    assert after[0]["text"] == before[0]["text"] and after[6]["text"] is None
    untouched = [k for k in before if k not in (1, 2, 3)]
    assert all(after[k]["text"] == before[k]["text"] for k in untouched)
    assert spans.remove_repeats(no_docs).count() == 0


def test_pieces_are_the_text(odd_docs):
    rng = random.Random(2)
    texts = [r["text"] or "" for r in odd_docs.collect()]
    parts = ["ab", "c. ", "d ", "  ", "\n", "é ", "f! ", "gg", "漢。 ", '" ', ".) ", "x y z ", "؟ ", "...", "\x0b"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(300)]
    for text in texts:
        assert "".join(spans.units_of(text)) == text
        assert spans.units_of(text) == (pieces(text)[0] or [text] * bool(text))


def test_names_that_clash(spark):
    rows = [(1, 7, "a. " * 30, 5, "x"), (2, 8, "a. " * 30, 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, _span_id long, text string, _span_gone long, `_span.mark` string")
    out = spans.remove_repeats(docs, removed="_span_mark")
    assert out.columns == [*docs.columns, "_span_mark"]
    assert sorted(tuple(r)[:5] for r in out.collect()) == [(1, 7, "a. ", 5, "x"), (2, 8, "", 6, "y")]


ALPHABETS = ["bcdfgst", "бвгджз", "αβγδεζ", "אבגדהו", "ঘচজট"]


def test_passages_at_random_places_go(spark):
    """Passages of over 50 words in five scripts, with and without stops: the second copy loses all but what
    lies at its ends, and texts that share nothing lose nothing."""
    rng = random.Random(11)

    def text(n, letters, stops):
        words = ["".join(rng.choices(letters, k=rng.randint(3, 6))) for _ in range(n)]
        return [w + rng.choice(stops) * (rng.random() < 0.12) for w in words]

    rows, passages = [], []
    for k in range(150):
        letters, stops = ALPHABETS[k % 5], ([".", "!", "?"], ["."], ["。", "؟"], [""])[k // 5 % 4]
        passage = text(rng.randint(51, 80), letters, stops)
        passages.append(passage)
        for copy in range(2):
            own = text(150, letters, stops)
            at = rng.randint(0, 150)
            rows.append((2 * k + copy, " ".join(own[:at] + passage + own[at:])))
    rows.append((500, "One sentence of a dozen and some more words that is in both of these texts here."))
    rows.append((501, "Other. One sentence of a dozen and some more words that is in both of these texts here."))
    rows += [(600 + k, " ".join(text(200, ALPHABETS[k % 5], ["."]))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = dict(map(tuple, spans.remove_repeats(docs).select("doc_id", "text").collect()))
    assert sorted(found.items()) == sorted((i, t) for i, t, _ in cut_repeats(rows))
    texts = dict(rows)
    for k, passage in enumerate(passages):
        assert found[2 * k] == texts[2 * k]
        left, n = found[2 * k + 1].split(), len(passage)
        kept = {tuple(left[i : i + 21]) for i in range(len(left) - 20)}
        assert not any(tuple(passage[i : i + 21]) in kept for i in range(n - 20)), k
        assert 150 <= len(left) <= 150 + 22
    assert all(found[i] == texts[i] for i in found if i >= 500)

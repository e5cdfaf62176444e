import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from eventlens.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, docs, plain, length):
    """Every id is in one piece, sequences are gapless and at most so long."""
    wanted = sorted((plain(t) for _, t in docs), key=repr)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(p["ids"]) == 4 * p["length"] > 0
    ids_of = defaultdict(list)
    for i, t in docs:
        ids_of[i].append(plain(t))
    for i, texts in ids_of.items():
        have = sorted((p["doc_tokens"], p["start"], bytes(p["ids"])) for p in by_doc[i])
        assert sum(p["length"] for p in by_doc[i]) == sum(map(len, texts))
        if len(texts) == 1:
            joined = b"".join(ids for _, _, ids in have)
            assert np.frombuffer(joined, "<u4").tolist() == texts[0]
            assert [s for _, s, _ in have] == np.cumsum([0] + [len(x) // 4 for _, _, x in have[:-1]]).tolist()
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == length or at < length and at & (at - 1) == 0
    assert len(wanted) == len(docs)


@pytest.mark.parametrize(("length", "windows", "merge"), [(2048, 64, 1 << 20), (64, 3, 500), (16, 1, 40)])
def test_packing(spark, some_docs, plain, length, windows, merge):
    docs = spark.createDataFrame(some_docs, "doc_id long, text string").repartition(6)
    pieces = packing.pack(docs, FILE, length=length, windows=windows, merge_tokens=merge).collect()
    check(pieces, some_docs, plain, length)


def test_packing_odd_rows(spark, odd_docs, no_docs, plain):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(packing.pack(odd_docs, FILE, length=128, windows=4).collect(), rows, plain, 128)
    assert packing.pack(no_docs, FILE).count() == 0


def test_encoder_is_the_library(plain):
    own = packing.Encoder(FILE, known_pieces=50)
    assert own.by_piece
    rng = np.random.default_rng(3)
    letters = "".join(map(chr, range(256))) + "'" * 30 + "sstdrevm ll  12"
    texts = ["".join(rng.choice(list(letters), rng.integers(0, 200))) for _ in range(200)]
    texts += ["'s't're", "it's we'll'd I'M ''s", "日本 <|endoftext|> x", "ﬀ Σίσυφος", "á é", "", "  ", "x" * 3000]
    got = [np.frombuffer(ids, "<u4").tolist() + [1] for ids in own.many(texts)]
    assert got == [plain(t) for t in texts]
    assert zlib.crc32(own.many(["one two"])[0]) == zlib.crc32(np.array(plain("one two")[:-1], "<u4").tobytes())

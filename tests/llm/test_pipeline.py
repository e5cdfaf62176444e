"""The pipeline's stages, each on what the one before has kept."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm import queries

from .conftest import prose, sentence
from .test_near import components, cut_repeats


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, odd_docs):
    """``documents`` and ``labels`` with toxic texts, copies, near copies and a shared passage."""
    rng = random.Random(21)
    passage = " ".join(sentence(rng, 14) for _ in range(5))
    rows, labels = [], []
    for i in range(100, 700):
        words = prose(rng, 6).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(7):
                words.insert(rng.randrange(len(words)), rng.choice(["glimbrous", "wortzelpf", "skandrik"]))
        text = " ".join(words)
        if i % 50 == 1:
            text = rows[0][1]
        if i % 50 == 3:
            text = text + " " + passage
        rows.append((i, text, "en", "src0" if i % 3 else f"src{i % 7}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd_docs.select(docs.columns))
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def steps(spark, tables):
    """The documents and what each stage makes of them."""
    out = [queries.table(spark, tables, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tables}/{name}"
        stage(spark, out[-1], tables).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_and_stages(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "mixing", "packing"]
    for df in steps[1:5]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_toxic_documents_go_and_clean_ones_stay(steps):
    before, after = rows_of(steps[0]), rows_of(steps[1])
    gone = {i for i, _ in before} - {i for i, _ in after}
    toxic = {i for i, _ in before if i is not None and 100 <= i < 700 and i % 6 == 0 and i % 50 != 1}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 3


def test_one_of_each_group_stays(steps):
    before, after = rows_of(steps[1]), rows_of(steps[2])
    group = {(i, t): c for (i, t), (_, _, c) in zip(before, components(before), strict=True)}
    want = Counter()
    for (i, t), c in group.items():
        if not (t or "").split() or i == c:
            want[(i, t)] += 1
    assert Counter(after) == want


def test_repeated_passages_go(steps):
    before, after = rows_of(steps[2]), rows_of(steps[3])
    want = [(i, t or "") for i, t, gone in cut_repeats(before) if not (gone and not t.strip())]
    assert Counter((i, t or "") for i, t in after) == Counter(want)
    sizes = steps[3].filter(F.length("text") != F.col("n_chars")).filter("doc_id >= 100")
    assert sizes.count() == 0


def test_every_document_is_mixed_in(steps):
    before, after = Counter(rows_of(steps[3])), Counter(rows_of(steps[4]))
    assert before.keys() == after.keys()
    assert max(after[k] / before[k] for k in before) <= 2 and sum(after.values()) > sum(before.values())


def test_packed(steps):
    pieces = steps[5].collect()
    lengths = Counter()
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        lengths[p["sequence_id"]] += p["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())
    assert {p["doc_id"] for p in pieces} == {i for i, _ in rows_of(steps[4])}


def test_run_on_nothing(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        queries.table(spark, tables, name).filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

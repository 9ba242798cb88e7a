import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from neighborflow.llm import minhash, quality, toxicity

from .corpora import hard_texts, prose

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_on_the_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, ids = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if n < 3:
            assert out.columns == columns
        after = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
        if name == "packing":
            assert after == before
        else:
            ids.append(before - after)
        docs = out if n < 3 else docs
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(ids[0] & clean) <= 0.02 * len(clean) and len(ids[0] & toxic) >= 0.6 * len(toxic)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(ids[1] & good) <= 0.02 * len(good)
    assert ids[2]


def test_dedup_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f g h", "en"), (2, "a b c d e f g h", "en"), (2, "a b c d e f g h", "en"), (9, "x y z", "en"), (None, "a b c d e f g h", "en"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = corpus_pipeline.drop_repeated(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["2", "9", "None", "None"]


def test_dedup_keeps_each_text_of_a_shared_id(spark):
    rows = [(1, "a b c d e f g h", "x"), (3, "a b c d e f g h", "x"), (3, "p q r s t u v w", "x"), (3, "i j k l m n o p", "x"), (3, "i j k l m n o p", "x"), (4, "p q r s t u v w", "x"), (5, "y z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Row string")
    got = corpus_pipeline.drop_repeated(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["text"] for r in got.collect()) == ["a b c d e f g h", "i j k l m n o p", "p q r s t u v w", "y z"]


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.keep(docs, toxicity.fit(docs, labels, F.lit(True))).count() == 0
    assert quality.keep(docs, quality.fit(docs, labels, F.lit(True))).count() == 0
    assert corpus_pipeline.drop_repeated(spark, docs, "").count() == 0
    assert corpus_pipeline.pack(spark, docs, "").count() == 0
    assert minhash.near_duplicates(spark, docs).count() == 0


def hard_documents(spark):
    """Null, empty, very long and repeated texts, null and repeated ids, and columns with the names that stages make."""
    rng = random.Random(8)
    texts = [*hard_texts(), prose(rng, 200_000)] + [prose(rng, 60) for _ in range(20)]
    rows = [(None if i == 3 else i, t, None if i % 4 == 0 else "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[15], rows[16], (17, "another text under one id " * 3, "en", "web", 78)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "row", "kept", "digest", "component_id", "predicted", "ids", "length", "label"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs, texts


@pytest.fixture
def labelled(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["toxicity", "quality", "near-dedup"])
def test_filtering_stages_on_hard_tables(spark, labelled, name):
    """Columns stay; kept rows are rows of the input; equal texts are judged alike; nothing crashes."""
    docs, _ = hard_documents(spark)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, labelled)
    assert got.columns == docs.columns
    rows_, kept = Counter(map(tuple, docs.collect())), Counter(map(tuple, got.collect()))
    assert not kept - rows_ and kept
    if name == "near-dedup":
        named = [r for r in kept.elements() if r[0] is not None]
        assert len({r[1] for r in named if r[1]}) == len([r for r in named if r[1]])  # one row for each text
    else:
        fate = {}
        for r, n in rows_.items():
            assert kept[r] in (0, n)
            assert fate.setdefault(r[1] or "", kept[r] > 0) == (kept[r] > 0)


def test_packing_of_hard_tables(spark, labelled):
    docs, texts = hard_documents(spark)
    got = corpus_pipeline.pack(spark, docs, labelled).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert max(r["length"] for r in got) <= 4096 and sum(r["length"] == 1 for r in got) >= 2  # empty texts: the end id
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096

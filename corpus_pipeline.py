"""The corpus pipeline: documents without toxic, poor and repeated ones, packed into sequences.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and calls one operator of
``neighborflow.llm``. All but the last return the columns of ``docs``. ``run`` writes each stage's result as Parquet in
the shared folder and reads it again for the next.

Defined results, for every stage: a null text counts as empty and its row is judged like any other; equal texts are judged
alike; texts are used whole at any length; repeated rows are kept or dropped together, but for near-dedup, which keeps one
of them; extra columns are carried, whatever their names; an empty table gives an empty one; without labels of both kinds
nothing is rejected as toxic, and all have the share of good labels as quality (1.0 without any).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.llm import minhash, packing, quality, toxicity
from neighborflow.llm.common import Scratch, table
from neighborflow.llm.queries import tokenizer_file


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; one at 0.5 goes."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), _fold(5) != 0))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; one at 0.7 stays."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels"), _fold(4) != 2))


def _by_row(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that names a doc_id's text: the doc_id for the first of its texts by digest, for others a
    hash of both that comes after all ids under 2^62."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    clashes = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias(f"{name}_lo"), F.max(digest).alias(f"{name}_hi")).where(f"{name}_lo <> {name}_hi").drop(f"{name}_hi")
    clashes = Scratch(spark, "clashes").save(clashes, "ids")
    own = F.col("doc_id").cast("long")
    if clashes.isEmpty():
        return docs.withColumn(name, own)
    other = F.xxhash64("doc_id", digest).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return docs.join(clashes, "doc_id", "left").withColumn(name, F.when(digest != F.col(f"{name}_lo"), other).otherwise(own)).select(*docs.columns, name)


def drop_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five-word shingles, 0.8 or more), one row of
    it. Different texts under one doc_id are documents of their own; rows without a doc_id cannot be told apart and stay."""
    name = "row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    rows = _by_row(spark, docs, name)
    groups = minhash.near_duplicates(spark, rows.select(F.col(name).alias("doc_id"), "text"), minhash.MinHashParams())
    kept = groups.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    named = rows.where(F.col(name).isNotNull()).join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence of at most 4096 tokens; an empty text is its end id alone."""
    return packing.pack_documents(spark, docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near-dedup", drop_repeated), ("packing", pack)]

#: Models and packing are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if n:
                scratch.drop(STAGES[n - 1][0])
    return docs

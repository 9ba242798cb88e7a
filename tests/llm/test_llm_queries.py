"""The registered queries on whole small tables: their columns, one row per row, and brute force or SQL where there is one."""

import os
import zlib

import duckdb
import pandas as pd
import pytest

from neighborflow.llm import minhash
from neighborflow.llm.queries import ORACLES, QUERIES

from .test_minhash import truth

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
COLUMNS = {
    "op1_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4_quality_classifier": "doc_id held_out score predicted",
    "op6_html_extraction": "page_id url text n_chars",
    "op7_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op10_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_exact_topk": "query_id rank vec_id score",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}
KEYS = dict.fromkeys(COLUMNS, ("documents", "doc_id")) | {"op2_token_counts": ("documents", "doc_id"), "op5_sentencepiece": ("documents", "doc_id"), "op6_html_extraction": ("pages", "page_id"), "op1_chat_formatting": ("conversations", "conv_id")}
for name in ("op11_spelling_variants", "op12_exact_topk"):  # rows are words and ranks
    del KEYS[name]


def rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    got = QUERIES[name](spark, DATA)
    assert got.columns[: len(COLUMNS.get(name, "").split())] == COLUMNS.get(name, "").split()
    if name in KEYS:
        source, key = KEYS[name]
        want = {r[0] for r in spark.read.parquet(f"{DATA}/{source}.parquet").select(key).distinct().collect()}
        assert {r[key] for r in got.select(key).collect()} - {-7} == want


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_exact_topk", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA).toPandas()
    want = con.sql(ORACLES[name]).df()[list(got.columns)]
    by = list(got.columns)
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True), want.sort_values(by).reset_index(drop=True), check_dtype=False)


def test_chat_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    got = QUERIES["op1_chat_formatting"](spark, DATA).toPandas()
    want = con.sql(ORACLES["op1_chat_formatting"]).df()[list(got.columns)]
    plain = lambda df: [tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, (float, int)) else str(x) for x in r) for r in df.sort_values("conv_id").itertuples(index=False)]
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name,mod,fold,bar", [("op4_quality_classifier", 4, 2, 0.7), ("op8_toxicity", 5, 0, 0.5)])
def test_folds_and_predictions(spark, name, mod, fold, bar):
    for r in rows(spark, name):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= bar)


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_of_real_rows_against_all_pairs(spark, k):
    """No link between the documents of the small table is lost, for shingles of two words and of five."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = sorted(docs.collect(), key=lambda r: r["doc_id"])
    p = minhash.MinHashParams(k=k)
    comp, sizes = truth([r["text"] for r in held], p)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark, docs, p).collect()}
    assert [got[r["doc_id"]]["component_id"] for r in held] == [held[c]["doc_id"] for c in comp]
    assert [got[r["doc_id"]]["n_shingles"] for r in held] == sizes

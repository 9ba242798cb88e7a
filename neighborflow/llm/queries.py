"""The queries of the training-data operators: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.llm import chat, fingerprint, html, media, merkle, minhash, packing, pieces, quality, spelling, sql, tokencount, topk, toxicity
from neighborflow.llm.common import table

#: The added conversation of op1: texts that hold a head and the end mark.
PLANTED_CHAT = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_CHAT).alias("text"))
    return chat.digests(chat.read_back(chat.format_chats(rows.unionByName(more))))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(table(spark, sf_dir, "documents")))


def _remainder(n: int):
    """crc32 of doc_id as text, mod n: the fold of a row."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, _remainder(4) != 2)
    return quality.score(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, _remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")
    ids = F.col("ids")
    return pieces.decode(pieces.encode(spark, docs, model), model).select(
        "doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("ids_sha256"), F.length("text").cast("long").alias("decoded_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(spark, table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), minhash.MinHashParams(k=2))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark, table(spark, sf_dir, "documents"), _remainder(3) == 0)


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_token_counts": op2_token_counts,
    "op3_media_columns": op3_media_columns,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_html_extraction": op6_html_extraction,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_topk": op12_exact_topk,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op11_spelling_variants": sql.spelling(),
    "op12_exact_topk": sql.topk(),
    "op13_merkle_manifest": sql.merkle(),
    "op1_chat_formatting": """
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\b'), '</turn>', '\\0'), '### System:', '\\1'), '### User:', '\\2'), '### Assistant:', '\\3'), '### Role <', '\\4'), '>:', '\\5') AS esc,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos
            FROM r
        ), p AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
                   length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### Role <' || role || '>: ' END) + length(esc) + length(' </turn>' || chr(10)) AS len
            FROM e
        ), q AS (
            SELECT *, CASE WHEN pos = 0 THEN role IN ('system', 'user')
                           WHEN prev IN ('system', 'assistant') THEN role = 'user'
                           WHEN prev = 'user' THEN role = 'assistant' ELSE false END AS ok
            FROM p
        ), a AS (
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   sum(len) AS formatted_chars, min(pos) FILTER (WHERE NOT ok) AS bad, arg_max(role, pos) AS last
            FROM q GROUP BY conv_id
        )
        SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
               CAST(formatted_chars AS BIGINT) AS formatted_chars, bad IS NULL AND last = 'assistant' AS valid,
               CAST(CASE WHEN bad IS NOT NULL THEN bad WHEN last <> 'assistant' THEN n_turns END AS BIGINT) AS bad_turn
        FROM a
    """
}

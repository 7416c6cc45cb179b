"""The thin queries over the given tables: each applies one operator and derives its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratiowatch.llm import (archive, chat, contamination, counts, language, lines, near, packing, quality, ranked, secrets,
                            token_ids, whitening)
from ratiowatch.llm.encoding import vocabulary
from ratiowatch.llm.sql import SQL  # noqa: F401
from ratiowatch.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark)
    token_ids.write_ids(_table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), "spaced", end_id=2)
    return token_ids.digest(spark, folder)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = contamination.build_index(_table(spark, sf_dir, "documents"))
    found = contamination.judged(contamination.find_passages(index, _table(spark, sf_dir, "benchmark"), window=13))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "bare", end_id=0, capacity=2048)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark)
    archive.write_archive(_table(spark, sf_dir, "pages"), folder)
    return archive.read_archive(spark, folder).select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        archive.base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = language.train(docs.where(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"), components=32)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES = {f.__name__: f for f in (
    op1_token_ids, op2_line_dedup, op3_quality_rules, op4_secret_scan, op5_near_dedup, op6_decontamination, op7_best_fit_packing, op8_warc,
    op9_token_counts, op10_language_id, op11_embedding_whitening, op12_ranked_search, op13_chat_formatting)}

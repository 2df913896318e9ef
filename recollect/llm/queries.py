"""The contracts' queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, context_tree, encoding, fingerprints, hard_negatives, licenses, merkle, near_dedup, oracles, packing, quality, secrets, toxicity, urls

# Host labels whose pages make up the example list of blocked URLs.
LISTED_LABELS = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("blocks")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).drop("distance")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    kind = turns.schema
    own = spark.range(2).select(F.lit(-7).cast(kind["conv_id"].dataType).alias("conv_id"), F.col("id").cast(kind["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.conversation_digest(turns.unionByName(own))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urls.host_and_path(F.col("url"))
    listed = pages.where(F.exists(F.split(host, r"\."), lambda x: x.isin(LISTED_LABELS))).select(urls.canonical(F.col("url")).alias("url"))
    return urls.judge_urls(pages, listed).drop("by")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(_table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 finds by phrases alone, which SQL can say: its other labels come from the method."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict:
    own = [op1_near_duplicates, op2_context_tree_scores, op3_fingerprints, op4_license_scans, op5_quality_rules, op6_secret_scans, op7_packing, op8_bpe_round_trip, op9_chat_format, op10_url_filter, op11_merkle_manifest, op12_hard_negatives, op13_toxicity, license_phrases]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against brute force in the tests."""
    return {
        "op1_near_duplicates": oracles.near_duplicates(), "op9_chat_format": oracles.chat_digest(), "op10_url_filter": oracles.url_verdicts(urls.RULES, LISTED_LABELS), "op11_merkle_manifest": oracles.merkle(),
        "op12_hard_negatives": oracles.hard_negatives(), "license_phrases": oracles.license_phrases(licenses.PHRASES, licenses.WORD),
    }

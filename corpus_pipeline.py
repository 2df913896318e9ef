"""From documents to packed training sequences; each stage takes all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recollect.llm import near_dedup, packing, quality, secrets
from recollect.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's estimate keep; null texts fail, an empty table stays empty."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates; rows without words or without an id all stay."""
    return near_dedup.keep_one_of_each(docs, k=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew; null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence, with its token ids; a null text is the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality rules", quality_rules), ("near-duplicates", one_of_each), ("secrets", without_secrets), ("packing", packed)]

# Near-duplicate sketches and tokenization are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents that the stages keep: pack_documents()'s rows, ids included.

    Each stage is written in full and read again, so what a lost executor held is made again from the stage before.
    Columns of documents beyond its own five pass through to the last stage, which takes doc_id and text.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(n))
    return docs

"""The corpus pipeline: five stages, each an operator of stockcast.llm, written as Parquet in between.

1. Language ID by compression: documents without a letter, or whose two best languages compress the text
   to nearly the same size, go.
2. SimHash near-dedup: one document of each group stays; among those, edited copies that its radius does not reach
   (five-word shingles, Jaccard similarity of 0.8 or more) go too.
3. Secret scan: every secret found is replaced in its text.
4. Mixing: documents, whole or cut at block ends, are taken up to three times so that sources meet their targets.
5. Byte-level BPE: token ids of every text, checked by decoding.

A stage lowers the session's spark.sql.execution.arrow.maxBytesPerBatch, as its frame runs after it has returned it; run() sets it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockcast.llm import bpe, language_id, mixing, resemblance, secret_scan
from stockcast.llm.components import BATCH_BYTES, clear_scratch, delete, ensure_checkpoint_dir, scratch_made, small_batches

#: The least margin between the two best languages: below it they are as good as tied.
LEAST_MARGIN = 0.001
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with texts handed to workers in small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(docs.sparkSession)
        return stage(spark, docs, sf_dir)

    return run_stage


@lean
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.confident(docs, LEAST_MARGIN)


@lean
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resemblance.keep_one(docs, fingerprints=True)


@lean
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@lean
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: Compression, SimHash components and BPE are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's rows kept below the checkpoint folder until the next one is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batch_bytes = spark.conf.get(BATCH_BYTES)
    try:
        for k, (_, stage) in enumerate(STAGES):
            others = scratch_made()
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            clear_scratch(spark, others)
            if k:
                delete(spark, f"{folder}/{k - 1}")
            docs = spark.read.parquet(f"{folder}/{k}")
    finally:
        spark.conf.set(BATCH_BYTES, batch_bytes)
    return docs

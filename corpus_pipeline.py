"""The corpus pipeline: stages applied one after another to ``documents``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from repoquarry.llm import bpe, decontaminate, minhash, quality, secrets
from repoquarry.llm.process import small_batches
from repoquarry.sources.shared import new_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels outside of its held-out fold train it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.fit_quality(docs, labels))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of every group of near-duplicates."""
    return minhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = decontaminate.benchmark_items(benchmark)
    return decontaminate.keep_clean(docs, decontaminate.fit_space(docs, benchmark), items)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redact(docs, secrets.fit_detector(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digests of ids and of the text decoded from them."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """The stage with small batches between the JVM and Python."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _bounded(keep_quality)),
    ("minhash_near_dedup", _bounded(keep_first_copies)),
    ("benchmark_decontamination", _bounded(drop_benchmark_leaks)),
    ("secret_scans", _bounded(redact_secrets)),
    ("bpe_encoding", _bounded(encode)),
]

# The classifier, the redaction and the encoder are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is stored and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

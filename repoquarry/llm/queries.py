"""One query per operation of this package over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm import minhash
from repoquarry.llm.bpe import encode_decode
from repoquarry.llm.decontaminate import benchmark_items, fit_space, leaks
from repoquarry.llm.embeddings import near_duplicates
from repoquarry.llm.html import extract_text
from repoquarry.llm.lines import LineIndex
from repoquarry.llm.merkle import digest_of, manifest
from repoquarry.llm.process import small_batches
from repoquarry.llm.quality import fit_quality, score_quality
from repoquarry.llm.secrets import fit_detector, scan
from repoquarry.llm.sharding import shard_by_bytes
from repoquarry.llm.toxicity import fit_toxicity, score_toxicity
from repoquarry.llm.warc import read_warc, write_warc
from repoquarry.llm.whitening import whiten
from repoquarry.sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(function)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        small_batches(spark)
        return function(spark, sf)

    QUERIES[function.__name__] = run
    return run


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_bpe_encode_decode(spark, sf):
    return encode_decode(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_toxicity(spark, sf):
    docs = _table(spark, sf, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf, "labels")))


@query
def op3_minhash_near_dedup(spark, sf):
    return minhash.near_duplicates(_table(spark, sf, "documents"))


@query
def op4_quality_classifier(spark, sf):
    docs = _table(spark, sf, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf, "labels")))


@query
def op5_secret_scans(spark, sf):
    docs = _table(spark, sf, "documents")
    return scan(docs, fit_detector(docs))


@query
def op6_warc_writer(spark, sf):
    folder = new_folder(spark, "warc")
    write_warc(_table(spark, sf, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_benchmark_decontamination(spark, sf):
    docs, benchmark = _table(spark, sf, "documents"), _table(spark, sf, "benchmark")
    return leaks(docs, fit_space(docs, benchmark), benchmark_items(benchmark))


@query
def op8_embedding_near_dedup(spark, sf):
    return near_duplicates(_table(spark, sf, "embeddings"))


@query
def op9_sharding(spark, sf):
    return shard_by_bytes(_table(spark, sf, "documents"))


@query
def op10_html_extraction(spark, sf):
    return extract_text(_table(spark, sf, "pages"))


@query
def op11_line_dedup(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    kept = LineIndex.over(docs).deduplicated_members(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op12_embedding_whitening(spark, sf):
    return whiten(_table(spark, sf, "embeddings"))


_LARGE, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op13_merkle_manifest(spark, sf):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(tampered, digest_of(*fields, F.translate("text", _LARGE, _SMALL)))
    found = manifest(_table(spark, sf, "documents"), digest_of(*fields, F.col("text")), claimed)
    proof = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")

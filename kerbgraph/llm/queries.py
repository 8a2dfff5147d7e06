"""The queries of the thirteen operators over the driver's tables, and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, divergence, fingerprint, hamming_search, html_text, language_id, license_scan, merkle, near_dup, sentencepiece_codec, sharding, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def piece_model(folder: str = "/opt/tokenizers") -> str:
    """The SentencePiece model in the folder of public tokenizers; only the driver reads it."""
    return os.path.join(folder, "piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), piece_model())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components_of(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.neighbours(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.query(table(spark, sf_dir, "conversations"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_sentencepiece, op2_decontamination, op3_minhash_near_dup, op4_exact_top_k, op5_html_extraction, op6_language_id, op7_license_scan, op8_toxicity, op9_sharding, op10_chat_format, op11_fingerprints, op12_merkle_manifest, op13_source_divergence)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.ORACLE, "op4_exact_top_k": hamming_search.ORACLE, "op9_sharding": sharding.oracle(), "op10_chat_format": chat_format.ORACLE, "op12_merkle_manifest": merkle.oracle(), "op13_source_divergence": divergence.ORACLE}

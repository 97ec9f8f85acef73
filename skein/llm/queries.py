"""Registered queries of the training-data operators; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, decontamination, fingerprints, jaccard_join, language_id, licenses, negatives, packing, pii, quality, repair, sharding, topk
from skein.llm.common import documents

TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_query(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_against_next(documents(spark, sf_dir).select("doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_query(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_query(documents(spark, sf_dir))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_query(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_query(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_query(documents(spark, sf_dir))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_query(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_bpe": op5_bpe,
    "op6_fingerprints": op6_fingerprints,
    "op7_licenses": op7_licenses,
    "op8_sharding": op8_sharding,
    "op9_pii": op9_pii,
    "op10_topk": op10_topk,
    "op11_decontamination": op11_decontamination,
    "op12_negatives": op12_negatives,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op7_licenses": licenses.LICENCE_SQL,
    "op10_topk": topk.TOPK_SQL,
    "op11_decontamination": decontamination.DECONTAMINATION_SQL,
    "op12_negatives": negatives.NEGATIVES_SQL,
    "op13_repair": repair.REPAIR_SQL,
}

"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe_codec, chained_passages, crf_quality, decontaminate, exact_topk, license_scan, line_dedup, sharding, simhash_dedup, suffix_dedup
from lodestrata.llm.common import load

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained_passages.passages(load(spark, sf_dir, "documents"))


def op2_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return license_scan.scanned(docs, license_scan.train(docs))


def op3_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(load(spark, sf_dir, "embeddings"))


def op4_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(load(spark, sf_dir, "documents"))


def op5_bpe_bitmap_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encoded(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"), 40)


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return crf_quality.scored(docs, crf_quality.train(docs, load(spark, sf_dir, "labels")))


def op8_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(load(spark, sf_dir, "documents"))


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(load(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_collinear_passages,
    op2_license_classifier,
    op3_norm_sorted_topk,
    op4_simhash_deletion_variants,
    op5_bpe_bitmap_queue,
    op6_virtual_slots,
    op7_crf_quality,
    op8_minhash_lines,
    op9_wu_manber,
    op10_deep_shallow,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op3_norm_sorted_topk": exact_topk.ORACLE_SQL, "op9_wu_manber": decontaminate.ORACLE_SQL, "op10_deep_shallow": suffix_dedup.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text}

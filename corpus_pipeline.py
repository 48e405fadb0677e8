"""The corpus pipeline: documents through quality, line dedup, near-duplicate dedup and decontamination to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; ``run`` writes every stage's rows as
a Parquet table in the shared folder and reads them back as the next one's input, so a lost executor costs at most the
stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe_codec, crf_quality, decontaminate, line_dedup, simhash_dedup
from lodestrata.llm.common import load, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF accepts."""
    return crf_quality.keep_good(docs, crf_quality.train(docs, load(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that repeat, exactly or nearly, an earlier one."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and digests of what is left."""
    return bpe_codec.encoded(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]

#: Stages score with a trained model, fuzzy links and BPE merges, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs

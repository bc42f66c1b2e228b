"""Corpus pipeline: documents in, clean and tokenised documents out.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.  All stages but the last return
the columns of documents.

Defined results: null text counts as empty, and an empty text passes if its score does; very long texts are treated whole; of
equal rows one stays; rows of one doc_id with different texts are judged each by its text; rows with null doc_id are never near
duplicates and stay; ties go to the smallest doc_id; other columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wrenchlake.llm import bpe, decontamination, near_dedup, quality_gam, substring_dedup
from wrenchlake.llm.store import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the model learns from the labelled rows of ``docs``."""
    model = quality_gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words that occur more than once."""
    return substring_dedup.substring_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not overlap a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and the SHA-256 of the decoded text of each document."""
    return bpe.tokenised(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Learned scores, signatures and the tokenizer have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

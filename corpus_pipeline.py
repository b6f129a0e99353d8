"""Training-data pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir). Its result is written as Parquet and read again as the next one's docs, so each stage
sees all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import byte_bpe, decontaminate, line_dedup, minhash, quality
from orderloom.llm.common import shared_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.good(docs, table(spark, sf_dir, "labels"), docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines are cut out of the texts; documents with no words left go."""
    return with_length(line_dedup.deduplicated(docs), docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes."""
    path = byte_bpe.default_path()
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path), path))


def with_length(docs: DataFrame, given: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    if "n_chars" not in given.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(given.schema["n_chars"].dataType)).select(given.columns)


STAGES = [
    ("quality", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]
#: Trained weights, hashes and merges are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

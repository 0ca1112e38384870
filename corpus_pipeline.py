"""The training-data pipeline: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, written as Parquet
and read again by whoever runs the stages one at a time. `run` chains them in one session and deletes
a stage's intermediate tables once its result is written.

Every stage works on all rows and whole texts that it gets. Defined cases: null and empty texts pass
quality only if their score does, link with nothing, hold no benchmark window, have size 0 in the mixture
(which takes them as often as their source's other documents) and size 8 in a shard; of repeated rows one
stays, unless they are empty or without id; a table that is empty, or that a stage empties, gives
an empty result with all columns; columns of any other name are carried through (those beginning `__`
are reserved, and `shard` and `slot` are set by the last stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontam, mix, neardup, quality_pu, shard
from corvane.llm.common import settle_last, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifier rejects."""
    return quality_pu.keep_good(docs, table(spark, sf_dir, "labels"), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, similarity of 0.8 or more)."""
    return neardup.keep_one(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark text."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet their target weights, none more than twice."""
    return mix.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot by jump consistent hashing."""
    return shard.shard_documents(docs, 24)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("shards", shards),
]

ORACLE_SQL = None  # a fitted classifier and signatures are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle_last(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs

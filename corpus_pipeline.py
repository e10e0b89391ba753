"""The corpus pipeline: five stages over ``documents``, each by one operator.

Every stage works on all that the one before kept, and is written as Parquet
and read again before the next. Toxic documents go, then all but one of each
group of near-duplicates (five-word shingles, Jaccard 0.8 or more); bytes of repeated 200-byte strings are cut out of
texts; documents that contain a benchmark item go; and the last stage says how
many words the mix to target weights takes of each document. Executors rest before
each stage, so that none starts beside the garbage of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import bwt_dedup, decontam, mixing, near_copies, toxicity
from sightline.llm.common import Scratch, rested


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rested(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rested(spark)
    return near_copies.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rested(spark)
    return bwt_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rested(spark)
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rested(spark)
    return mixing.taken(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", one_of_each),
    ("suffix_dedup", without_repeats),
    ("decontam", without_benchmark),
    ("mixing", mixed),
]

#: Trained scores and permutations have no SQL counterpart; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: language identification, exact and near deduplication, benchmark decontamination, mixing.

Each stage reads what the one before has written. All but the last return the columns of documents; the last
returns a row for each copy that the mix takes, with the copy's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, exact_dedup, language, mixing, simhash
from tracewell.llm.common import materialise


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letters or are in no learned language's script. Trees are learned from the stage's own labelled rows."""
    return language.keep_identified(docs, language.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest of each group of texts that are equal but for white space."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates."""
    return simhash.near_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that a benchmark's passages contaminate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source asks for."""
    return mixing.mixture(docs)


STAGES = [("language", identify), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("mix", mixture)]

#: Fingerprints, trained trees and tilted rates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Working tables of operators that need more than one pass, in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir was given. Where neither is set, a local master gets a temporary folder; any other is refused."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracewell-"))  # the session remembers it
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/tracewell/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there, what an iteration builds on is stored once, and a lost executor costs no more than its own tasks."""
    df.write.parquet(path := new_path(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a broadcast may hold: rows, and bytes of the table's files.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 8 << 20


def fits(table: DataFrame) -> bool:
    """Whether a written table of narrow rows is within both bounds."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS


def bounded(table: DataFrame, fit: bool | None = None) -> DataFrame:
    """table with a broadcast hint if it fits (or is known to); else with one for a sorted, shuffled join, whose hot keys the adaptive skew join splits. Spark alone would go by the bytes of files, and millions of rows that compress well would be broadcast."""
    return F.broadcast(table) if (fits(table) if fit is None else fit) else table.hint("merge")

"""Numbering, running sums and running extremes over long groups, in two levels.

Rows are dealt to tasks by ranges of their order and written with the number of their range. Windows run within ranges; the totals
of the ranges before, one row for each range and group, are added. No task sees a whole group, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.storage import bounded, written


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Writes and returns rows with ``__part``, the number of their range."""
    return written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")


def running(rows: DataFrame, by: list[str], order: list[Column | str], fold: str = "sum", before: bool = False, **values: Column) -> DataFrame:
    """rows with a running sum ("min", "max"), up to and with the row, or up to the row before it, of each of ``values`` within each group of ``by`` (no nulls there). The order must be total. Where there is nothing to fold a sum is 0, the others null."""
    whole = {"sum": F.sum, "min": F.min, "max": F.max}[fold]
    joined = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[fold]  # least and greatest skip nulls
    placed = ranged(rows.select("*", *(c.alias(f"__{k}") for k, c in values.items())), *by, *order)
    totals = placed.groupBy("__part", *by).agg(*(whole(f"__{k}").alias(k) for k in values))
    above = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = written(totals.select("__part", *by, *(whole(k).over(above).alias(f"__{k}_base") for k in values)), "bases")  # a row for each range and group within it
    upto = W.partitionBy("__part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    out = placed.join(bounded(base), ["__part", *by])
    return out.select(*rows.columns, *(joined(F.col(f"__{k}_base"), whole(f"__{k}").over(upto)).alias(k) for k in values))


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "n") -> DataFrame:
    """rows numbered from 1 within each group."""
    return running(rows, by, order, **{name: F.lit(1).cast("long")})


def trapezoids(curve: DataFrame, x: str, y: str) -> DataFrame:
    """One row (area): the area under a curve with distinct x."""
    placed = ranged(curve.select(F.col(x).alias("x"), F.col(y).alias("y")), "x")
    step = lambda w: (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    within = placed.select(step(W.partitionBy("__part").orderBy("x")).alias("step"))
    first, last = F.min(F.struct("x", "y")).alias("p"), F.max(F.struct("x", "y")).alias("q")
    ends = placed.groupBy("__part").agg(first, last)
    over = W.orderBy("__part")  # one row for each range
    between = ends.select(((F.col("p.x") - F.lag("q.x").over(over)) * (F.col("p.y") + F.lag("q.y").over(over)) / 2).alias("step"))
    return within.unionByName(between).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("area"))

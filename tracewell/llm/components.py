"""Connected components of a link table by alternating large-star and small-star steps, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node of its component.

    A large star hangs the larger neighbours of a node on its smallest neighbour, a small star does so with the
    smaller ones. The table never has more rows than links; hubs are reduced by partial minima, and the join that
    gives each link its hub's minimum is split by the adaptive skew join. Steps go on until no link changes. Links with a null end, and from a node to itself, are
    no links; repeated ones count once; without links there are no rows.
    """
    state = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    state, before = materialise(state, "links"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before or not now[0]:
            return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(state.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
        before = now
        both = state.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(state.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("lo"), F.least("u", "v").alias("m"))
        large = state.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        state = materialise(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")

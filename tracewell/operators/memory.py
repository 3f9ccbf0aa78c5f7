"""What nodes remember as of a batch: neighbours over several hops, and the messages of their last batch.

Batches are numbered in time. A node's edges are numbered over all batches in two levels (``running``), so a hub's history is in no single task,
and what a batch sees is found by number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.running import numbered, running
from tracewell.operators.storage import written


def ends_of(batches: DataFrame, *more: str) -> DataFrame:
    """Both ends of each edge: (batch, t, event_uuid, node, neighbour, sent, more); sent tells the source's row. Edges with a null batch or end are left out."""
    known = batches.where("batch IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    one = lambda a, b, sent: known.select("batch", "t", "event_uuid", F.col(a).alias("node"), F.col(b).alias("neighbour"), F.lit(sent).alias("sent"), *more)
    return one("src", "dst", True).union(one("dst", "src", False))


def as_of(history: DataFrame, asked: DataFrame, value: str, with_batch: bool = False) -> DataFrame:
    """asked (batch, node), distinct, with ``value`` of the node's latest row of history (batch, node, value; values rise with the batch) before the batch, or up to and with it; rows without any are left out."""
    rank = 1 if with_batch else 0
    rows = history.select("batch", "node", F.lit(1 - rank).alias("kind"), F.col(value).alias("__v")).unionByName(asked.select("batch", "node", F.lit(rank).alias("kind"), F.lit(None).cast(history.schema[value].dataType).alias("__v")))
    return running(rows, ["node"], ["batch", "kind"], "max", **{value: F.col("__v")}).where(f"kind = {rank} AND {value} IS NOT NULL").select("batch", "node", value)


def hop_neighbours(batches: DataFrame, size: int, hops: int, with_batch: bool = False) -> DataFrame:
    """(batch, hop, node, neighbour, e_id): the graph of last neighbours of each batch.

    The nodes of a batch are asked for their last ``size`` edges before it (with ``with_batch``: up to and with it), the nodes so met for theirs as of the same batch,
    and so on for ``hops`` hops; hop is the one that first asks for the node. A self loop counts for two edges of its node.
    """
    ends = written(numbered(ends_of(batches), ["node"], ["batch", "t", "event_uuid", "neighbour", "sent"], "r").select("batch", "node", "r", "neighbour", F.col("event_uuid").alias("e_id")), "ends")
    upto = written(ends.groupBy("node", "batch").agg(F.max("r").alias("upto")), "counts")
    front, known, found = upto.select("batch", "node"), [], []
    for hop in range(1, hops + 1):
        front = written(front, "asked")
        known.append(front)
        last = as_of(upto, front, "upto", with_batch)
        numbers = last.select("batch", "node", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("upto") - size + 1), F.col("upto"))).alias("r"))
        met = written(numbers.join(ends.drop("batch"), ["node", "r"]).select("batch", F.lit(hop).alias("hop"), "node", "neighbour", "e_id"), "met")
        found.append(met)
        if hop < hops:
            front = met.select("batch", F.col("neighbour").alias("node")).distinct().join(reduce(DataFrame.unionByName, known), ["batch", "node"], "left_anti")
    return reduce(DataFrame.unionByName, found)


def stored_messages(batches: DataFrame, value: str) -> DataFrame:
    """(batch, node, last_update, sent_n, sent_mean, sent_last, got_n, got_mean, got_last): what each node of a batch finds in its message stores.

    A node has a store for edges it sent and one for edges it got. Each holds the edges of the last batch that had any, until such a batch overwrites it: number, mean and last value
    (by t, then event_uuid) of ``value``. last_update is the latest time in both. Counts of empty stores are 0, the rest is null. Null values are messages without a part in the mean.
    """
    order = F.struct("t", "event_uuid", F.col(value).alias("x"))
    stores = written(ends_of(batches, value).groupBy("batch", "node", "sent").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(order).alias("last"), F.max("t").alias("t")), "stores")
    asked = written(stores.select("batch", "node").distinct(), "asked")
    out = asked
    for side, name in ((True, "sent"), (False, "got")):
        own = stores.where(F.col("sent") == side)
        place = as_of(own.select("batch", "node", F.col("batch").alias("at")), asked, "at")
        seen = place.join(own.select(F.col("batch").alias("at"), "node", F.col("n").alias(f"{name}_n"), F.col("mean").alias(f"{name}_mean"), F.col("last.x").alias(f"{name}_last"), F.col("t").alias(f"{name}_t")), ["at", "node"]).drop("at")
        out = out.join(seen, ["batch", "node"], "left").withColumn(f"{name}_n", F.coalesce(f"{name}_n", F.lit(0)))
    return out.select("batch", "node", F.greatest("sent_t", "got_t").alias("last_update"), *(f"{s}_{c}" for s in ("sent", "got") for c in ("n", "mean", "last")))

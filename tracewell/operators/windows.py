"""Cutting event streams into windows and batches, and fusing repeated edges within them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.running import numbered, running
from tracewell.operators.storage import written

ORDER = ("t", "event_uuid")


def quantised_windows(events: DataFrame, block: int = 1024, size_ns: int = 900_000_000_000, by: str = "day") -> DataFrame:
    """events with window number tw and the window's start_ns and end_ns, per value of ``by``.

    Events go in blocks of ``block`` in time order. A window closes at the first block whose last event is later than the window's
    start plus the size, or with the last block; the next one starts where it ended. Only the fold over blocks is sequential: it sees one
    row per block, and its result (a row per window) is joined back on block numbers.
    """
    placed = written(numbered(events, [by], [*ORDER], "block").withColumn("block", F.floor((F.col("block") - 1) / block).cast("int")), "blocks")
    blocks = placed.groupBy(by, "block").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("block"), []
        start, tw = int(pdf["first_t"].iloc[0]), 0
        last = pdf["block"].iloc[-1]
        opened = 0
        for b, t in zip(pdf["block"], pdf["last_t"], strict=True):
            if t > start + size_ns or b == last:
                out += [(b_, tw, start, t) for b_ in range(opened, b + 1)]
                start, tw, opened = t, tw + 1, b + 1
        return pd.DataFrame(out, columns=["block", "tw", "start_ns", "end_ns"]).assign(**{by: pdf[by].iloc[0]})

    kind = events.schema[by].dataType.simpleString()
    windows = blocks.groupBy(by).applyInPandas(fold, f"block int, tw int, start_ns long, end_ns long, {by} {kind}")
    windows = written(windows, "windows")  # a row for each block
    return placed.join(F.broadcast(windows) if windows.count() < 1_000_000 else windows, [by, "block"]).drop("block")


def fixed_windows(events: DataFrame, size_ns: int) -> DataFrame:
    return events.withColumn("tw", F.floor(F.col("t") / size_ns))


def fuse_runs(edges: DataFrame, *window: str) -> DataFrame:
    """The first edge of each run of equal operations between two nodes, in time order, within a window."""
    before = F.lag("op").over(W.partitionBy(*window, "src", "dst").orderBy(*ORDER))
    return edges.withColumn("__op", before).where(F.col("__op").isNull() | (F.col("__op") != F.col("op"))).drop("__op")


def pair_graphs(edges: DataFrame, *window: str, whole_day: str | None = None) -> DataFrame:
    """(window, src, dst, op, n): simple graphs, one edge for each pair within a window, with the operation of the pair's first event and how many events there were.

    With ``whole_day`` (the column of the day, one of ``window``) each window of a day gets the graph of the whole day: a row for each window and pair, by intention.
    """
    by = [whole_day] if whole_day else list(window)
    graphs = edges.groupBy(*by, "src", "dst").agg(F.min_by("op", F.struct(*ORDER)).alias("op"), F.count(F.lit(1)).alias("n"))
    return edges.select(*window).distinct().join(graphs, by).select(*window, "src", "dst", "op", "n") if whole_day else graphs


def row_batches(edges: DataFrame, size: int, *by: str) -> DataFrame:
    """edges with a batch number: ``size`` consecutive edges of each group, the last batch may be short."""
    return numbered(edges, [*by], [*ORDER], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))


def minute_batches(edges: DataFrame, slide_ns: int, length_ns: int, *by: str) -> DataFrame:
    """Tumbling batches from the first event's slot on; events after a batch's length are left out."""
    starts = edges.groupBy(*by).agg((F.floor(F.min("t") / slide_ns) * slide_ns).alias("__start"))
    placed = edges.join(starts, list(by)).withColumn("batch", F.floor((F.col("t") - F.col("__start")) / slide_ns))
    return placed.where(F.col("t") < F.col("__start") + F.col("batch") * slide_ns + length_ns).drop("__start")


def pair_batches(edges: DataFrame, by: str) -> DataFrame:
    """Greedy batches in which each (src, dst) comes once: a batch is cut before an edge whose pair it has.

    A batch that starts at a position ends before the first later position whose pair came since; that is the least next occurrence of any pair from the
    start on, a running minimum from the end. Following these pointers from the first edge gives the cuts: pointers are doubled, so
    the number of joins grows with the logarithm of the number of cuts. No task sees a whole group or a whole pair.
    """
    placed = written(numbered(edges, [by], [*ORDER], "__pos"), "placed")
    later = running(placed.select(by, "src", "dst", "__pos"), [by, "src", "dst"], [F.desc("__pos")], "min", True, again=F.col("__pos"))
    jump = running(later.select(by, "__pos", "again"), [by], [F.desc("__pos")], "min", to=F.col("again")).where("to IS NOT NULL")
    jump = written(jump.select(by, "__pos", "to"), "jumps")
    cuts = written(edges.select(by).distinct().withColumn("__pos", F.lit(1).cast("long")), "cuts")
    while True:
        new = written(cuts.join(jump, [by, "__pos"]).select(by, F.col("to").alias("__pos")), "cuts")
        if new.isEmpty():
            break
        cuts = written(cuts.unionByName(new), "cuts")
        further = jump.select(by, F.col("__pos").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(further, [by, "to"]).select(by, "__pos", F.col("further").alias("to")), "jumps")
    marked = placed.join(cuts.withColumn("__cut", F.lit(1)), [by, "__pos"], "left")
    return running(marked, [by], ["__pos"], batch=F.coalesce("__cut", F.lit(0))).withColumn("batch", (F.col("batch") - 1).cast("int")).drop("__pos", "__cut")


def local_ids(edges: DataFrame, *by: str) -> DataFrame:
    """(by, node, local): nodes of each batch numbered densely in order."""
    ids = edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ids.withColumn("local", F.row_number().over(W.partitionBy(*by).orderBy("node")) - 1)


def window_groups(edges: DataFrame, k: int) -> DataFrame:
    """Groups of k consecutive windows, numbered over the windows that have edges."""
    twins = edges.select("tw").distinct().withColumn("graph", F.floor((F.row_number().over(W.orderBy("tw")) - 1) / k).cast("int"))
    return edges.join(F.broadcast(twins) if twins.count() < 1_000_000 else twins, "tw")


def interval_stamps(ranges: DataFrame, low: str, high: str, step_ns: int, *by: str) -> DataFrame:
    """(by, t): of each range low, low + step, ... up to high, and high itself."""
    stamps = F.array_distinct(F.array_append(F.sequence(F.col(low), F.col(high), F.lit(step_ns).cast("long")), F.col(high)))
    return ranges.select(*by, F.explode(stamps).alias("t"))


def gaps(events: DataFrame, *key: str) -> DataFrame:
    """The key and the gap to the previous event of the same key, for all but the first. The previous time is the greatest before, a running maximum in two levels."""
    rows = running(events.select(*key, *ORDER), list(key), [*ORDER], "max", True, last=F.col("t"))
    return rows.select(*key, "t", (F.col("t") - F.col("last")).alias("gap")).where("gap IS NOT NULL")


def recency(events: DataFrame, size_ns: int, *key: str) -> DataFrame:
    """Per key and window: count, change of count, running means of count and density (events per second of the window)."""
    by = W.partitionBy(*key).orderBy("tw")
    n = events.withColumn("tw", F.floor(F.col("t") / size_ns)).groupBy(*key, "tw").agg(F.count(F.lit(1)).alias("n"))
    density = F.col("n") / (size_ns / 1e9)
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    return n.select(*key, "tw", "n", (F.col("n") - F.lag("n").over(by)).alias("change"), F.avg("n").over(upto).alias("mean_n"), (density - F.lag(density).over(by)).alias("density_change"), F.avg(density).over(upto).alias("mean_density"))


def chunks(events: DataFrame, n: int, *key: str) -> DataFrame:
    """Chunk number of each event within its key: n events a chunk, in time order."""
    return numbered(events, list(key), [*ORDER], "chunk").withColumn("chunk", F.floor((F.col("chunk") - 1) / n).cast("int"))


def window_name(start: Column, end: Column) -> Column:
    from tracewell.functions.times import eastern

    return F.concat(eastern(start), F.lit("~"), eastern(end))

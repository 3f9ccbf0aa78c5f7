"""Random walks and random pairs by seeded digests.

Edges of a node are numbered, and a walker draws the number of its next edge, so a step meets one row for each walker however many edges
a hub has. Draws are digests of the seed, the walker and the step: reruns and other engines draw alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.running import numbered, running
from tracewell.operators.storage import bounded, written

BEFORE_ALL = -(1 << 62)


def drawn(seed: int, *of: Column | str) -> Column:
    """A number of 60 bits: the first 15 hexadecimal digits of the md5 of the seed and the values, with bars between."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in of]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def reversed_edges(edges: DataFrame, in_time: bool = False) -> DataFrame:
    """edges turned round; with ``in_time`` their times are negated too, so that what went on in time goes back."""
    t = -F.col("t") if in_time else F.col("t")
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "op", t.alias("t"), "event_uuid")


def walks(edges: DataFrame, length: int, per_node: int, seed: int = 0, temporal: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """(walk, start, step, node, op): ``per_node`` walks of at most ``length`` nodes from each source (or each of ``starts`` (node) that is one).

    Each edge of a node is as likely as any other; temporal walks choose among those later than the edge they came by. Edges with null ends are left out,
    with null times from temporal walks too. A walk ends where nothing is left to choose; step 0 is its start, without op.
    """
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL" + (" AND t IS NOT NULL" if temporal else ""))
    out = numbered(known.select(F.col("src").alias("node"), F.col("dst").alias("next"), "op", F.col("t").alias("e_t"), "event_uuid"), ["node"], ["e_t", "event_uuid", "next", "op"], "r")
    out = written(out, "out-edges")
    degrees = written(out.groupBy("node").agg(F.max("r").alias("deg")), "degrees")
    following = bounded(degrees.select(F.col("node").alias("next"), F.col("deg").alias("next_deg")))
    passed = out.groupBy("node", F.col("e_t").alias("t")).agg(F.max("r").alias("seen"))
    passed = written(passed.select("node", "t", F.lit(0).alias("asks"), F.lit(None).cast(out.schema["node"].dataType).alias("start"), F.lit(None).cast("int").alias("walk"), F.lit(None).cast("long").alias("deg"), "seen"), "passed") if temporal else passed
    first = degrees if starts is None else degrees.join(starts.select("node").distinct(), "node", "left_semi")
    front = written(first.select(F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"), F.col("node").alias("start"), F.lit(0).alias("step"), "node", F.lit(None).cast("string").alias("op"), F.lit(BEFORE_ALL).alias("t"), "deg"), "walks")
    whole = front
    for step in range(1, length):
        waiting = front.where("deg IS NOT NULL").withColumn("seen", F.lit(0).cast("long"))
        if temporal and step > 1:
            asked = waiting.select("node", "t", F.lit(1).alias("asks"), "start", "walk", "deg", "seen")
            waiting = running(passed.unionByName(asked).withColumnRenamed("seen", "came"), ["node"], ["t", "asks", "start", "walk"], "max", seen=F.col("came")).where("asks = 1 AND deg > seen")
        chosen = waiting.select("walk", "start", "node", (F.col("seen") + 1 + F.pmod(drawn(seed, "start", "walk", F.lit(step)), F.col("deg") - F.col("seen"))).alias("r"))
        met = chosen.hint("merge").join(out, ["node", "r"]).join(following, "next", "left")  # walkers take few bytes in files: without the hint millions would be broadcast
        front = written(met.select("walk", "start", F.lit(step).alias("step"), F.col("next").alias("node"), "op", F.col("e_t").alias("t"), F.col("next_deg").alias("deg")), "walks")
        if front.isEmpty():
            break
        whole = whole.unionByName(front)
    return whole.drop("t", "deg")


def temporal_walks(edges: DataFrame, length: int, per_node: int, seed: int = 0) -> DataFrame:
    """Temporal walks from every node: forward in time from sources, backward from nodes that no edge leaves. Steps backward are negative, so that the order of steps is that of time."""
    only = edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    back = walks(reversed_edges(edges, in_time=True), length, per_node, seed, temporal=True, starts=only)
    return walks(edges, length, per_node, seed, temporal=True).unionByName(back.withColumn("step", -F.col("step")))


def degree_walks(edges: DataFrame, length: int, per_neighbour: int, seed: int = 0) -> DataFrame:
    """(start, walk, step, node, op): ``per_neighbour`` walks of at most ``length`` edges for each distinct neighbour of a source.

    A step draws a distinct neighbour, then one of the operations that lead there (a pair's distinct operations are as few as there are kinds). Edges with null ends or operations are left out.
    """
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL AND op IS NOT NULL")
    pairs = written(known.groupBy(F.col("src").alias("node"), F.col("dst").alias("next")).agg(F.array_sort(F.collect_set("op")).alias("ops")), "pairs")
    degrees = written(pairs.groupBy("node").agg(F.count(F.lit(1)).alias("deg")), "degrees")
    placed = numbered(pairs, ["node"], ["next"], "k").withColumn("k", F.col("k") - 1)
    near = written(placed.join(bounded(degrees.select(F.col("node").alias("next"), F.col("deg").alias("next_deg"))), "next", "left"), "neighbours")
    begun = near.select("node", "k").join(bounded(degrees), "node")  # a row for each neighbour: no node's walks are made in one row
    front = begun.select(F.col("node").alias("start"), "node", "deg", F.col("k"), F.explode(F.sequence(F.lit(0), F.lit(per_neighbour - 1))).alias("i"))
    front = written(front.select("start", (F.col("k") * per_neighbour + F.col("i")).alias("walk"), F.lit(0).alias("step"), "node", F.lit(None).cast("string").alias("op"), "deg"), "walks")
    whole = front
    for step in range(1, length + 1):
        of = ("start", "walk", F.lit(step))
        chosen = front.where("deg IS NOT NULL").select("start", "walk", "node", F.pmod(drawn(seed, *of), "deg").alias("k"))
        op = F.get("ops", F.pmod(drawn(seed + 1, *of), F.size("ops")).cast("int"))
        front = written(chosen.hint("merge").join(near, ["node", "k"]).select("start", "walk", F.lit(step).alias("step"), F.col("next").alias("node"), op.alias("op"), F.col("next_deg").alias("deg")), "walks")
        if front.isEmpty():
            break
        whole = whole.unionByName(front)
    return whole.drop("deg")


def negatives(edges: DataFrame, seed: int = 0) -> DataFrame:
    """A random pair per distinct edge, without self loops and pairs that are edges: sources in one digest order meet targets in another."""
    pairs = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "pairs")
    placed = lambda end, s: numbered(pairs.select("src", "dst", F.md5(F.concat_ws("|", F.lit(str(s)), F.col("src").cast("string"), F.col("dst").cast("string"))).alias("h")), [], ["h", "src", "dst"], "r").select(end, "r")
    met = placed("src", seed + 1).join(placed("dst", seed + 2), "r").where("src != dst")
    return met.select("src", "dst").distinct().join(pairs, ["src", "dst"], "left_anti")

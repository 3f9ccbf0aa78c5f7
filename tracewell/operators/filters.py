"""Predicates and small joins: keywords, targets, splits in time, limits, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.running import numbered
from tracewell.operators.walking import drawn

# Parts of labels of nodes that are not worth a queue.
KEYWORDS = [":", "/dev/pts", "salt-minion.log", "null", "usr", "proc", "firefox", "tmp", "thunderbird", "bin/", "/data/replay_logdb", "/stat", "/boot", "qt-opensource-linux-x64", "/eraseme", "675"]
LEGACY_KEYWORDS = [":", "null", "/dev/pts", "salt-minion.log", "675", "usr", "proc", "/.cache/mozilla/", "tmp", "thunderbird", "/bin/", "/sbin/sysctl", "/data/replay_logdb/", "/home/admin/eraseme", "/stat"]


def benign(label: Column, keywords: list[str] = KEYWORDS) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | label.contains(k)
    return out


def display_path(node_type: Column, path: Column, src: Column, src_port: Column, dst: Column, dst_port: Column) -> Column:
    """A node's path, or for a netflow its ends."""
    return F.when(node_type == "netflow", F.concat(src, F.lit(":"), src_port, F.lit("->"), dst, F.lit(":"), dst_port)).otherwise(path)


def without_type(name: Column) -> Column:
    """A node name without what follows its last underscore."""
    return F.regexp_replace(name, "_[^_]*$", "")


def to_targets(edges: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """Edges whose node, without its type, is a target."""
    return edges.withColumn("__target", without_type(F.col(column))).join(targets.select(F.col("target").alias("__target")).distinct(), "__target", "left_semi").drop("__target")


def time_split(merged: DataFrame, early: int, later: int) -> DataFrame:
    """Each key's times up to ``early`` and after ``later``."""
    return merged.withColumn("before", F.filter("times", lambda t: t <= early)).withColumn("after", F.filter("times", lambda t: t > later))


def first_rows(events: DataFrame, n: int, *by: str) -> DataFrame:
    """The first n events of each group: the small graphs of test mode."""
    return events.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy("t", "event_uuid"))).where(F.col("__n") <= n).drop("__n")


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, a, b): nodes that two runs put in different classes."""
    return a.select("node", F.col("category").alias("a")).join(b.select("node", F.col("category").alias("b")), "node").where("a != b")


def as_of_neighbours(batches: DataFrame, size: int) -> DataFrame:
    """(batch, node, neighbour, e_id): for each node of a batch its last ``size`` edges before the batch. Edges are ranked once per node, in two levels; a batch sees those between the
    number that had come before it and ``size`` less, so nothing is joined that isn't kept."""
    ends = batches.select("batch", "t", "event_uuid", F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(batches.select("batch", "t", "event_uuid", "dst", "src"))
    ranked = numbered(ends, ["node"], ["batch", "t", "event_uuid", "neighbour"], "r")
    come = ranked.groupBy("node", "batch").agg((F.min("r") - 1).alias("before"))
    wanted = come.where("before > 0").withColumn("r", F.explode(F.sequence(F.greatest(F.lit(1), F.col("before") - size + 1), F.col("before"))))
    return wanted.join(ranked.select("node", "r", "neighbour", F.col("event_uuid").alias("e_id")), ["node", "r"]).select("batch", "node", "neighbour", "e_id")


def capped_properties(edges: DataFrame, cap: int, *by: str) -> DataFrame:
    """(by, node, props): operations and neighbours of a node's first edges, at most ``cap`` edges of each node."""
    ends = edges.select(*by, "t", "event_uuid", "op", F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select(*by, "t", "event_uuid", "op", "dst", "src"))
    kept = ends.withColumn("r", F.row_number().over(W.partitionBy(*by, "node").orderBy("t", "event_uuid", "other"))).where(F.col("r") <= cap)
    return kept.groupBy(*by, "node").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "op", "other"))), lambda s: F.array(s["op"], s["other"].cast("string")))).alias("props"))


def batch_summary(batches: DataFrame, *by: str) -> DataFrame:
    """Count, total and mean time and edges of batches."""
    return batches.groupBy(*by).agg(F.count(F.lit(1)).alias("batches"), F.sum("edges").alias("edges"), F.round(F.sum("ms"), 3).alias("ms"), F.round(F.avg("ms"), 6).alias("mean_ms"))


def mean_gaps(events: DataFrame, *by: str) -> DataFrame:
    """Mean seconds between neighbouring events of a group, with its first and last times."""
    n = F.count(F.lit(1))
    return events.groupBy(*by).agg(F.round(F.when(n > 1, (F.max("t") - F.min("t")) / (n - 1) / 1e9).otherwise(0.0), 6).alias("mean_gap"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def full_recall_threshold(results: DataFrame) -> DataFrame:
    """The lowest score of a positive, and the share of negatives at or above it, in per cent."""
    least = results.where("y = 1").agg(F.min("score").alias("threshold"))
    return results.where("y = 0").join(F.broadcast(least), F.lit(True)).groupBy("threshold").agg(F.round(100 * F.avg((F.col("score") >= F.col("threshold")).cast("int")), 6).alias("fp_percent"))


def local_outliers(train: DataFrame, queries: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """(q, lof): local outlier factors from a table of k nearest neighbours (q, r, d) of queries and training rows alike."""
    kth = neighbours.groupBy("q").agg(F.max("d").alias("kd"))
    reach = neighbours.join(kth.select(F.col("q").alias("r"), F.col("kd").alias("rk")), "r").groupBy("q").agg((1 / (F.avg(F.greatest("d", "rk")) + 1e-10)).alias("lrd"))
    near = neighbours.join(reach.select(F.col("q").alias("r"), F.col("lrd").alias("near")), "r").groupBy("q").agg(F.avg("near").alias("near"))
    return near.join(reach, "q").join(queries.select("q"), "q", "left_semi").select("q", (F.col("near") / F.col("lrd")).alias("lof"))


def mimicry(events: DataFrame, processes: DataFrame, files: DataFrame, templates: list[list[str]], quota: int, seed: int = 0) -> DataFrame:
    """``quota`` times a process, a file, a time of the stream and a template of operations, all by hash: events one ns apart."""
    spark = events.sparkSession
    span = events.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    pick = lambda salt, n: F.pmod(drawn(seed, F.lit(salt), "id"), n)
    at = lambda rows: numbered(rows.select("node", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string"))).alias("h")), [], ["h", "node"], "r").select("node", (F.col("r") - 1).alias("r"))
    np_, nf = processes.count(), files.count()
    tries = spark.range(quota).select("id", pick("p", F.lit(max(np_, 1))).alias("p"), pick("f", F.lit(max(nf, 1))).alias("f"), pick("k", F.lit(len(templates))).cast("int").alias("k"))
    rows = tries.join(at(processes).select(F.col("node").alias("src"), F.col("r").alias("p")), "p").join(at(files).select(F.col("node").alias("dst"), F.col("r").alias("f")), "f").join(F.broadcast(span), F.lit(True))
    ops = F.array(*[F.array(*map(F.lit, t)) for t in templates])
    start = F.col("lo") + F.pmod(drawn(seed, F.lit("t"), "id"), F.col("hi") - F.col("lo") + 1)
    return rows.select("id", "src", "dst", start.alias("start"), F.posexplode(F.get(ops, F.col("k"))).alias("i", "op")).select("src", "dst", "op", (F.col("start") + F.col("i")).alias("t"))

"""Small operators around results: sizes of graphs, windows of nodes, repairs, names, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.running import numbered


def used_nodes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node_id, ...) of nodes that some edge has."""
    return labels.join(edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct(), "node_id", "left_semi")


def graph_sizes(edges: DataFrame, *by: str) -> DataFrame:
    """One row: graphs, and mean, least and largest numbers of their edges and nodes."""
    e = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("e"))
    n = edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    stats = [f(c).alias(f"{k}_{name}") for c, name in (("e", "edges"), ("n", "nodes")) for k, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("min", F.min), ("max", F.max))]
    return e.join(n, list(by)).agg(F.count(F.lit(1)).alias("graphs"), *stats)


def results_by_window(results: DataFrame, members: DataFrame) -> DataFrame:
    """Results of nodes (node, ...) repeated for each window (tw, node) they are in."""
    return members.select("tw", "node").distinct().join(results, "node")


def tainted(base: DataFrame, other: DataFrame, flag: Column, *key: str) -> DataFrame:
    """Rows of base whose batch is flagged in another run."""
    return base.join(other.where(flag).select(*key).distinct(), list(key), "left_semi")


def repaired(neighbours: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbour rows (node, neighbour, e_id) whose ends are those of their edge, either way round."""
    own = edges.select(F.col("event_uuid").alias("e_id"), "src", "dst")
    same = ((F.col("node") == F.col("src")) & (F.col("neighbour") == F.col("dst"))) | ((F.col("node") == F.col("dst")) & (F.col("neighbour") == F.col("src")))
    return neighbours.join(own, "e_id").where(same).drop("src", "dst")


def relative_times(batches: DataFrame, last: DataFrame) -> DataFrame:
    """batches (batch, src, t, ...) with dt: the source's last update before the batch (batch, node, t) less the edge's time; null for new nodes."""
    return batches.join(last.select("batch", F.col("node").alias("src"), F.col("t").alias("__last")), ["batch", "src"], "left").withColumn("dt", F.col("__last") - F.col("t")).drop("__last")


def by_count(merged: DataFrame, least: int, *key: str) -> DataFrame:
    """Merged edges with at least so many times and their rank, those with fewest times first."""
    rows = merged.withColumn("n", F.size("times").cast("long")).where(F.col("n") >= least)
    return numbered(rows.select(*key, "n"), [], ["n", *key], "rank")


def numeric_key(name: Column) -> Column:
    """All digits of a name as one number: the order in which files of windows sort."""
    return F.regexp_replace(name, "[^0-9]", "").cast("decimal(38,0)")


def merged_pseudo(nodes: DataFrame, column: str, prefix: str = "pseudo_") -> DataFrame:
    """Distinct nodes, pseudo ones under the name of their original."""
    return nodes.withColumn(column, F.regexp_replace(column, "^" + prefix, "")).distinct()


def adjacency(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(u, v, op, u_type, v_type) for export, sorted within tasks."""
    t = types.select("node_id", "node_type")
    out = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "op").distinct()
    out = out.join(t.select(F.col("node_id").alias("u"), F.col("node_type").alias("u_type")), "u").join(t.select(F.col("node_id").alias("v"), F.col("node_type").alias("v_type")), "v")
    return out.select("u", "v", "op", "u_type", "v_type")


def write_by_window(losses: DataFrame, path: str) -> None:
    """Losses as one folder for each split and window, rows in each file in order of time."""
    losses.repartition("split", "tw").sortWithinPartitions("split", "tw", "t").write.mode("overwrite").partitionBy("split", "tw").option("header", True).csv(path)


def audit_token(text: Column) -> Column:
    """A value as one token: blanks and quotes as underscores."""
    return F.translate(F.coalesce(text, F.lit("")), ' "', "__")


def audit_path(text: Column, fallback: str) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed.isin("", "N/A"), fallback).otherwise(trimmed)


def audit_title(text: Column) -> Column:
    """The text's bytes in lowercase hex."""
    return F.lower(F.hex(F.when(F.coalesce(text, F.lit("")) == "", F.lit("unknown")).otherwise(text).cast("binary")))


def discrimination_tps(results: DataFrame, attack_nodes: DataFrame, k: int) -> DataFrame:
    """(attack_id, tps): nodes of each attack with scores above the mean of the k best benign ones."""
    mean = results.where("y = 0").orderBy(F.desc("score"), "node").limit(k).agg(F.avg("score").alias("level"))
    hits = attack_nodes.join(results.select(F.col("node").alias("node_id"), "score"), "node_id", "left").join(F.broadcast(mean), F.lit(True))
    return hits.groupBy("attack_id").agg(F.count_if(F.col("score") > F.col("level")).alias("tps"))

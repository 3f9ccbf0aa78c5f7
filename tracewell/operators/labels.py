"""Ground truth joined to events, windows and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SELECTIONS = ("src_node", "dst_node", "both_nodes", "either_node")


def resolve_truth(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ground-truth rows (node_uuid, ...) with their node_id; rows that no node has go."""
    return truth.join(nodes.select("node_uuid", "node_id"), "node_uuid")


def attack_events(events: DataFrame, attacks: DataFrame) -> DataFrame:
    """Events inside attacks' closed time ranges, with the attack. Attacks are a catalogue of a few rows."""
    return events.join(F.broadcast(attacks), F.col("t").between(F.col("start_ns"), F.col("end_ns"))).drop("start_ns", "end_ns")


def induced(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events both of whose ends are among nodes (node_id)."""
    ids = nodes.select("node_id").distinct()
    return events.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*events.columns)


def selected(selection: str, src_bad: Column, dst_bad: Column) -> Column:
    return {"src_node": src_bad, "dst_node": dst_bad, "both_nodes": src_bad & dst_bad, "either_node": src_bad | dst_bad}[selection]


def malicious_edges(events: DataFrame, attacks: DataFrame, attack_nodes: DataFrame, selection: str = "both_nodes") -> DataFrame:
    """(attack_id, src, dst, t, op): edges of attacks whose ends are attack nodes as the selection asks."""
    inside = attack_events(events, attacks)
    s = attack_nodes.select("attack_id", F.col("node_id").alias("src"), F.lit(True).alias("src_bad")).distinct()
    d = attack_nodes.select("attack_id", F.col("node_id").alias("dst"), F.lit(True).alias("dst_bad")).distinct()
    marked = inside.join(s, ["attack_id", "src"], "left").join(d, ["attack_id", "dst"], "left")
    bad = selected(selection, F.coalesce("src_bad", F.lit(False)), F.coalesce("dst_bad", F.lit(False)))
    return marked.where(bad).select("attack_id", "src", "dst", "t", "op").distinct()


def malicious_per_window(events: DataFrame, windows: DataFrame, attacks: DataFrame, attack_nodes: DataFrame) -> DataFrame:
    """(tw, node_id, n): malicious ends of attack events strictly inside each window, counted. The interval join goes over buckets as long as the longest window."""
    inside = attack_events(events, attacks)
    ends = inside.select("attack_id", "t", F.explode(F.array("src", "dst")).alias("node_id")).join(attack_nodes.distinct(), ["attack_id", "node_id"], "left_semi").select("t", "node_id")
    size = windows.agg(F.max(F.col("end_ns") - F.col("start_ns"))).first()[0] or 1
    wide = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ns") / size), F.floor(F.col("end_ns") / size))))
    met = ends.withColumn("bucket", F.floor(F.col("t") / size)).join(wide, "bucket").where((F.col("t") > F.col("start_ns")) & (F.col("t") < F.col("end_ns")))
    return met.groupBy("tw", "node_id").agg(F.count(F.lit(1)).alias("n"))


def memberships(attack_nodes: DataFrame) -> DataFrame:
    """node_id -> sorted attacks."""
    return attack_nodes.groupBy("node_id").agg(F.array_sort(F.collect_set("attack_id")).alias("attacks"))


def mark(rows: DataFrame, truth: DataFrame, on: list[str], name: str = "y") -> DataFrame:
    """rows with 1 where truth has the key, else 0."""
    return rows.join(truth.select(*on).distinct().withColumn(name, F.lit(1)), on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def eligible_share(edges: DataFrame, eligible: DataFrame, by: str, key: tuple[str, ...] = ("src", "dst", "op")) -> DataFrame:
    """Per batch: edges, those of eligible keys, and their share."""
    hit = mark(edges, eligible, list(key), "hit")
    return hit.groupBy(by).agg(F.count(F.lit(1)).alias("edges"), F.sum("hit").alias("eligible"), F.round(F.avg("hit"), 6).alias("share"))


def with_vectors(edges: DataFrame, vectors: DataFrame, default: Column, key: tuple[str, ...] = ("src", "dst", "op")) -> DataFrame:
    """Edges with their key's vector, or the default."""
    return edges.join(vectors, list(key), "left").withColumn("vec", F.coalesce("vec", default))

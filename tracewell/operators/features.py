"""Features of nodes, edges and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.storage import bounded, written
from tracewell.operators.tiles import tiled

# The legal kinds of edges, (source, target): operations.
TRIPLETS = {
    ("subject", "subject"): ["EVENT_READ", "EVENT_WRITE", "EVENT_OPEN", "EVENT_CONNECT", "EVENT_RECVFROM", "EVENT_SENDTO", "EVENT_CLONE", "EVENT_SENDMSG", "EVENT_RECVMSG"],
    ("subject", "file"): ["EVENT_WRITE", "EVENT_CONNECT", "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_CLONE"],
    ("subject", "netflow"): ["EVENT_WRITE", "EVENT_SENDTO", "EVENT_CONNECT", "EVENT_SENDMSG"],
    ("file", "subject"): ["EVENT_READ", "EVENT_OPEN", "EVENT_RECVFROM", "EVENT_EXECUTE", "EVENT_RECVMSG"],
    ("netflow", "subject"): ["EVENT_OPEN", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG"],
}


def triplet_table(spark, triplets: dict = TRIPLETS) -> DataFrame:
    """(src_type, dst_type, op, triplet): classes numbered in the order of the catalogue."""
    rows = [(s, d, op) for (s, d), ops in triplets.items() for op in ops]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src_type string, dst_type string, op string, triplet int")


def with_triplets(edges: DataFrame, table: DataFrame) -> DataFrame:
    """edges with their class; kinds that the catalogue lacks are class 0."""
    return edges.join(F.broadcast(table), ["src_type", "dst_type", "op"], "left").withColumn("triplet", F.coalesce("triplet", F.lit(0)))


def type_distribution(edges: DataFrame, types: list[str], *by: str) -> DataFrame:
    """Per node: out- and in-counts by type over the largest count of their group."""
    ends = edges.select(*by, "op", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("node"), F.lit("in").alias("way")))).alias("e")).select(*by, "op", "e.*")
    counts = ends.groupBy(*by, "node").agg(*(F.count_if((F.col("op") == t) & (F.col("way") == w)).alias(f"{w}_{t}") for w in ("out", "in") for t in types))
    counts, names = written(counts, "type-counts"), [f"{w}_{t}" for w in ("out", "in") for t in types]
    tops = written(counts.groupBy(*by).agg(*(F.max(c).alias(f"__{c}") for c in names)), "type-tops")  # no window over a group: a hot one stays spread
    whole = counts.join(bounded(tops), list(by)) if by else counts.join(F.broadcast(tops), F.lit(True))
    return whole.select(*by, "node", *(F.round(F.when(F.col(f"__{c}") == 0, 0.0).otherwise(F.col(c) / F.col(f"__{c}")), 6).alias(c) for c in names))


def scatter_mean(edges: DataFrame, vec: str, *by: str) -> DataFrame:
    """(by, node, i, mean): the mean, for each place of the vector, over edges that touch the node."""
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("node"), vec)
    return ends.select(*by, "node", F.posexplode(vec).alias("i", "x")).groupBy(*by, "node", "i").agg(F.round(F.avg("x"), 6).alias("mean"))


def z_scores(rows: DataFrame, vec: str, key: str) -> DataFrame:
    """(key, i, z): each place less its mean over its sample deviation; deviations below 1e-8 count as 1."""
    flat = rows.select(key, F.posexplode(vec).alias("i", "x"))
    stats = flat.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    s = F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s"))
    return flat.join(F.broadcast(stats), "i").select(key, "i", F.round((F.col("x") - F.col("m")) / s, 5).alias("z"))


def norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def norm_stats(rows: DataFrame, vec: str) -> DataFrame:
    n = norm(vec)
    return rows.agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.round(F.min(n), 6).alias("min"), F.round(F.max(n), 6).alias("max"))


def knn_scores(train: DataFrame, queries: DataFrame, k: int = 10, vec: str = "embedding", key: str = "vec_id", block: int = 4096) -> DataFrame:
    """(key, score): mean distance of each query to its k nearest training vectors other than itself. A stated query set against all rows: both are dealt to blocks of about ``block`` rows, however many there are; each pair of blocks gives the k
    nearest of each of its queries, nothing else leaves it, and these are merged. Training vectors with a null are left out; the score of a query with one is null."""
    blocks, parts = max(1, -(-train.count() // block)), max(1, -(-queries.count() // block))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fine = F.coalesce(F.forall(vec, lambda x: x.isNotNull()), F.lit(False))
    values = F.col(vec).cast("array<double>")
    a = queries.where(fine).select(F.col(key).alias("q"), values.alias("qv"), deal(parts).alias("part"), every(blocks).alias("block"))
    b = train.where(fine).select(F.col(key).alias("p"), values.alias("pv"), F.lit(1).cast("long").alias("n"), deal(blocks).alias("block"), every(parts).alias("part"))
    first = tiled(a, b, ["part", "block"], k, True)
    best = first.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "p"))), 1, k).alias("near"))
    scores = best.select(F.col("q").alias(key), F.round(F.aggregate("near", F.lit(0.0), lambda s, x: s + x["dist"]) / F.size("near"), 5).alias("score"))
    return scores.unionByName(queries.where(~fine).select(key, F.lit(None).cast("double").alias("score")))


def host_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct hosts over several columns, and rows."""
    hosts = rows.select(F.explode(F.array(*columns)).alias("host")).distinct().agg(F.count(F.lit(1)).alias("hosts"))
    return hosts.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("flows"))), F.lit(True))

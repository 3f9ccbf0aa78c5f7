"""Vectors of edges: what their times look like, and messages of types and node vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import one_hot
from tracewell.operators.mixtures import histogram, quantiles
from tracewell.operators.storage import bounded, written

PARTS = [*(f"kde{i}" for i in range(5)), "mean", "std", "skew", "kurt", *(f"{f}{k}" for k in (1, 2, 3) for f in ("cos", "sin")), "q25", "q50", "q75", "n", "range"]
TINY = 1e-6
#: Grid points of all keys of a task, about: a task's table of sums has a row for each.
SUMS = 500_000


def quadrature(points: int = 10) -> tuple[list[float], list[float]]:
    nodes, weights = np.polynomial.hermite.hermgauss(points)
    return [float(x) for x in nodes], [float(w) for w in weights]


def time_vectors(values: DataFrame, column: str, *key: str, positive: bool = True) -> DataFrame:
    """(key, PARTS): 20 numbers about the values of each key. The density estimate (Scott's bandwidth) at the first five of ten Gauss-Hermite nodes, times their weights; four moments; the
    characteristic function at three frequencies of the mean; quartiles, count and range. Positive values only (gaps), or all (times). Keys with fewer than two values, or without spread, have zeros.

    Aggregates and joins on the key; quartiles come from ranks in two levels: no key's values meet in one task.
    """
    x = F.col(column).cast("double")
    rows = values.select(*key, x.alias("x"))
    keys = rows.select(*key).distinct()
    rows = rows.where("x > 0") if positive else rows
    stats = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.stddev_samp("x").alias("s"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"),
        (F.max("x") - F.min("x")).alias("range"),
    ).where("n > 1 AND s > 0")
    quartiles = quantiles(histogram(rows, "x", *key), {"q25": 0.25, "q50": 0.5, "q75": 0.75}, *key)
    stats = stats.join(quartiles, list(key))
    nodes, weights = quadrature()
    h = F.pow("n", F.lit(-0.2)) * F.col("s")
    spread = F.when(F.col("std") < TINY, 1.0).otherwise(F.col("std"))

    def density(node: float) -> Column:
        at = F.col("mean") + spread * float(np.sqrt(2)) * node
        z = ((F.greatest(at, F.lit(TINY)) if positive else at) - F.col("x")) / h
        return F.avg(F.exp(-0.5 * z * z) / (h * float(np.sqrt(2 * np.pi))))

    turn = lambda k: 2 * float(np.pi) * k * F.col("x") / (F.col("mean") + TINY)
    aggs = [(density(nodes[i]) * weights[i]).alias(f"kde{i}") for i in range(5)] + [F.avg(g(turn(k))).alias(f"{f}{k}") for k in (1, 2, 3) for f, g in (("cos", F.cos), ("sin", F.sin))]
    parts = rows.join(stats.select(*key, "n", "mean", "std", "s"), list(key)).groupBy(*key).agg(*aggs)
    whole = keys.join(stats.drop("s"), list(key), "left").join(parts, list(key), "left")
    return whole.select(*key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PARTS))


def with_vectors(edges: DataFrame, vectors: DataFrame, *key: str) -> DataFrame:
    """edges with the vector of their key (an array) and whether there is one; zeros where there is none."""
    found = vectors.select(*key, F.array(*PARTS).alias("vector"), F.lit(True).alias("known"))
    zero = F.array_repeat(F.lit(0.0), len(PARTS))
    return edges.join(found, list(key), "left").withColumn("vector", F.coalesce("vector", zero)).withColumn("known", F.coalesce("known", F.lit(False)))


def messages(edges: DataFrame, node_types: list[str], ops: list[str], src_vec: str | None = None, dst_vec: str | None = None) -> DataFrame:
    """edges (src_type, dst_type, op) with msg: one-hot source type, the source's vector, one-hot operation, one-hot target type, the target's vector. An operation outside the list has zeros."""
    place = lambda c, of: F.array_position(F.array(*map(F.lit, of)), F.col(c)).cast("int") - 1
    hot = lambda c, of: one_hot(F.coalesce(place(c, of), F.lit(-1)), len(of)).cast("array<double>")
    parts = [hot("src_type", node_types), *([F.col(src_vec)] if src_vec else []), hot("op", ops), hot("dst_type", node_types), *([F.col(dst_vec)] if dst_vec else [])]
    return edges.withColumn("msg", F.concat(*parts))


def fields(msg: Column, node_types: int, ops: int, dims: int = 0) -> dict[str, Column]:
    """The parts of a message by name."""
    out, at = {}, 1
    for name, size in (("src_type", node_types), ("src_vec", dims), ("edge_type", ops), ("dst_type", node_types), ("dst_vec", dims)):
        out[name] = F.slice(msg, at, size)
        at += size
    return out


def argmax(vec: Column) -> Column:
    """The first place of the largest number, from 0."""
    return F.array_position(vec, F.array_max(vec)).cast("int") - 1


def edge_features(parts: dict[str, Column], msg: Column, wanted: list[str], triplet: Column | None = None, triplets: int = 0) -> Column:
    """The features wanted of an edge, in the order edge_type, edge_type_triplet, msg."""
    have = {"edge_type": lambda: parts["edge_type"], "edge_type_triplet": lambda: one_hot(triplet, triplets).cast("array<double>"), "msg": lambda: msg}
    return F.concat(*(f() for name, f in have.items() if name in wanted))


def pseudo_points(mixture: str) -> Column:
    """(x, weight) of three points for each component that keep its mean and variance (Gauss-Hermite)."""
    points = lambda c: F.array(
        F.struct((c["mean"] - F.sqrt(3 * c["var"])).alias("x"), (c["weight"] / 6).alias("weight")), F.struct(c["mean"].alias("x"), (c["weight"] * 2 / 3).alias("weight")), F.struct((c["mean"] + F.sqrt(3 * c["var"])).alias("x"), (c["weight"] / 6).alias("weight"))
    )
    return F.flatten(F.transform(F.col(mixture), points))


def divergence(values: DataFrame, mixtures: DataFrame, column: str, *key: str, grid: int = 128, floor: float = 1e-12) -> DataFrame:
    """(key, kl): the divergence of a key's density estimate from its mixture, on a grid over its values and three bandwidths beside them. Keys are dealt to as many tasks as keep each one's grid points few, however many keys there are."""
    rows = values.select(*key, F.col(column).cast("double").alias("x"))
    stats = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).where("n > 1 AND s > 0")
    h = F.pow("n", F.lit(-0.2)) * F.col("s")
    at = stats.select(*key, h.alias("h"), (F.col("low") - 3 * h).alias("a"), ((F.col("high") - F.col("low") + 6 * h) / (grid - 1)).alias("dx"))
    at = written(at, "grids")
    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-at.count() * grid // SUMS))
    z = (F.col("a") + F.col("i") * F.col("dx") - F.col("x")) / F.col("h")
    each = rows.repartition(tasks, *key).join(bounded(at), list(key)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    p = each.groupBy(*key, "i", "a", "dx").agg(F.avg(F.exp(-0.5 * z * z) / (F.col("h") * float(np.sqrt(2 * np.pi)))).alias("p"))
    g = F.col("a") + F.col("i") * F.col("dx")
    q = F.aggregate("mixture", F.lit(0.0), lambda s, c: s + c["weight"] * F.exp(-0.5 * (g - c["mean"]) * (g - c["mean"]) / c["var"]) / F.sqrt(2 * float(np.pi) * c["var"]))
    both = p.join(mixtures.select(*key, "mixture"), list(key)).withColumn("p", F.greatest("p", F.lit(floor))).withColumn("q", F.greatest(q, F.lit(floor)))
    return both.groupBy(*key).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")) * F.col("dx")).alias("kl"))

"""Collapsing repeated temporal edges and summarising their times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.mixtures import histogram, quantiles
from tracewell.operators.running import numbered

KEY = ("src", "dst", "op")


def multiplicity(events: DataFrame) -> DataFrame:
    return events.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def multiplicity_stats(events: DataFrame, above: int = 10) -> DataFrame:
    """One row over the pairs with more than ``above`` events; zeros if there are none."""
    n = multiplicity(events).where(F.col("n") > above)
    q = {f"p{p}": F.percentile("n", F.lit(p / 100)) for p in (25, 50, 75, 90, 95, 99)}
    stats = {"pairs": F.count(F.lit(1)).cast("double"), "mean": F.avg("n"), "min": F.min("n").cast("double"), "max": F.max("n").cast("double"), "std": F.stddev_pop("n")} | q
    return n.agg(*(F.round(F.coalesce(v, F.lit(0.0)), 6).alias(k) for k, v in stats.items()))


def merged_edges(events: DataFrame, *key: str) -> DataFrame:
    """The key with its sorted times."""
    return events.groupBy(*key).agg(F.array_sort(F.collect_list("t")).alias("times"))


def merge_sets(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Two merged-edge tables as one: times of equal keys are joined."""
    return a.unionByName(b).groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("times"))).alias("times"))


def counts(events: DataFrame, least: int = 10) -> DataFrame:
    """Edges with their counts, and whether they are frequent."""
    return events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("frequent", F.col("n") >= least)


def collapse_all(edges: DataFrame, *window: str) -> DataFrame:
    """One row for each edge and window: its first event, first and last time, count."""
    first = F.min_by("event_uuid", F.struct("t", "event_uuid"))
    return edges.groupBy(*window, *KEY).agg(first.alias("event_uuid"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


def collapse_eligible(edges: DataFrame, eligible: DataFrame, *window: str) -> DataFrame:
    """Edges of the eligible keys collapse to their first event in a window; others stay as they are."""
    own = W.partitionBy(*window, *KEY)
    rows = edges.join(eligible.select(*KEY).distinct().withColumn("hit", F.lit(True)), list(KEY), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("t", "event_uuid"))).withColumn("n", F.count(F.lit(1)).over(own))
    return rows.where("NOT hit OR rank = 1").withColumn("n", F.when(F.col("hit"), F.col("n")).otherwise(F.lit(1).cast("long"))).drop("rank")


def temporal_features(collapsed: DataFrame, *window: str) -> DataFrame:
    """first, last (scaled to the window's range of times) and log count of collapsed edges."""
    ends = collapsed.groupBy(*window).agg(F.min("first_t").alias("__low"), F.max("last_t").alias("__high"))
    low, width = F.col("__low"), F.col("__high") - F.col("__low")
    reach = F.when(width < 1e-6, 1.0).otherwise(width.cast("double"))
    return collapsed.join(ends, list(window)).select(*window, *KEY, ((F.col("first_t") - low) / reach).alias("f_first"), ((F.col("last_t") - low) / reach).alias("f_last"), (F.log1p("n") / 10).alias("f_count"))


def reduction_stats(edges: DataFrame, collapsed: DataFrame, *window: str) -> DataFrame:
    """Per window: original, reduced, removed and their ratio in per cent."""
    a = edges.groupBy(*window).agg(F.count(F.lit(1)).alias("original"))
    b = collapsed.groupBy(*window).agg(F.count(F.lit(1)).alias("reduced"))
    return a.join(b, list(window)).withColumn("removed", F.col("original") - F.col("reduced")).withColumn("ratio", F.round(100.0 * F.col("removed") / F.col("original"), 6))


def split_totals(stats: DataFrame, split: str = "split") -> DataFrame:
    """Sums over windows, and the mean of their ratios."""
    return stats.groupBy(split).agg(F.sum("original").alias("original"), F.sum("reduced").alias("reduced"), F.sum("removed").alias("removed"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))


def min_time_diffs(edges: DataFrame) -> DataFrame:
    """Edges fused by their attributes: least and greatest distance to the first time of their destination."""
    first = edges.groupBy("dst").agg(F.min("t").alias("first"))
    return edges.join(first, "dst").withColumn("d", F.col("t") - F.col("first")).groupBy(*KEY).agg(F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.count(F.lit(1)).alias("n"))


def moments(values: DataFrame, column: str, *key: str) -> DataFrame:
    """Count, mean, deviation, biased skewness and excess kurtosis, quartiles and range per key (no nulls there). Quartiles come from ranks in two levels: no task holds a key's distinct values."""
    x = F.col(column)
    quartiles = quantiles(histogram(values, column, *key), {"q25": 0.25, "q50": 0.5, "q75": 0.75}, *key)
    return values.groupBy(*key).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.coalesce(F.skewness(x), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(x), F.lit(0.0)).alias("kurt"),
        (F.max(x) - F.min(x)).cast("double").alias("range"),
    ).join(quartiles, list(key), "left")


def fourier(values: DataFrame, column: str, frequencies: int, *key: str) -> DataFrame:
    """Mean cosine and sine of the values scaled to their range, for each frequency: the empirical characteristic function."""
    ends = values.groupBy(*key).agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    reach = F.col("__high") - F.col("__low")
    scaled = values.join(ends, list(key)).withColumn("x", (F.col(column) - F.col("__low")) / F.when(reach == 0, 1.0).otherwise(reach.cast("double")))
    cols = [g(f(2 * 3.141592653589793 * k * F.col("x"))).alias(f"{name}{k}") for k in range(1, frequencies + 1) for name, f, g in (("cos", F.cos, F.avg), ("sin", F.sin, F.avg))]
    return scaled.groupBy(*key).agg(*cols)


def kde_at(values: DataFrame, column: str, nodes: list[float], *key: str) -> DataFrame:
    """Gaussian density estimates at mean + node * std for each key, with Scott's bandwidth n^(-1/5) times the sample deviation."""
    x = F.col(column).cast("double")
    stats = values.groupBy(*key).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1 AND s > 0")
    placed = values.select(*key, x.alias("x")).join(stats, list(key))
    h = F.pow("n", F.lit(-0.2)) * F.col("s")
    z = lambda node: (F.col("m") + node * F.col("s") - F.col("x")) / h
    return placed.groupBy(*key).agg(*(F.avg(F.exp(-0.5 * z(v) * z(v)) / (h * 2.5066282746310002)).alias(f"kde{i}") for i, v in enumerate(nodes)))


def scaled(values: DataFrame, column: str, *key: str) -> DataFrame:
    """Min-max, standard and max-abs scaling within each key."""
    x, c = F.col(column).cast("double"), F.col
    stats = values.groupBy(*key).agg(F.min(x).alias("__low"), F.max(x).alias("__high"), F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"), F.max(F.abs(x)).alias("__top"))
    safe = lambda d: F.when(d == 0, 1.0).otherwise(d)
    out = values.join(stats, list(key)).withColumn("min_max", (x - c("__low")) / safe(c("__high") - c("__low"))).withColumn("standard", (x - c("__m")) / safe(c("__s"))).withColumn("max_abs", x / safe(c("__top")))
    return out.drop("__low", "__high", "__m", "__s", "__top")


def sample_long(events: DataFrame, n: int, seed: int, *key: str, by: str = "event_uuid") -> DataFrame:
    """At most n events of each key, chosen by a seeded digest of ``by``, ranked in two levels: long series are sampled before they are summarised."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string")))
    return numbered(events.withColumn("__h", digest), list(key), ["__h", by], "__r").drop("__h").where(F.col("__r") <= n).drop("__r")

"""Rankings: precision against attacks and recall, discrimination, prefixes, top-k clusters, best runs.

Rows are (node, score, y) with ties broken by node. Running sums over the whole ranking go in two levels (``operators.running``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.running import running as scan
from tracewell.operators.running import trapezoids


def order() -> list:
    return [F.desc("score"), F.asc("node")]


def running(results: DataFrame, attack_nodes: DataFrame | None = None) -> DataFrame:
    """results with rank, running tp and fp, and the running number of distinct attacks, in order of falling score."""
    rows = results.withColumn("new", F.lit(0))
    if attack_nodes is not None:
        place = F.struct("score", (-F.col("node")).alias("less"))
        placed = results.where("y = 1").join(F.broadcast(attack_nodes.withColumnRenamed("node_id", "node")), "node")
        first = placed.groupBy("attack_id").agg(F.max(place).alias("first")).groupBy((-F.col("first.less")).alias("node")).agg(F.count(F.lit(1)).alias("new"))
        rows = results.join(F.broadcast(first), "node", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    out = scan(rows, [], order(), rank=F.lit(1).cast("long"), tp=F.col("y"), attacks=F.col("new"))
    return out.withColumn("fp", F.col("rank") - F.col("tp")).drop("new")


def adp_curve(results: DataFrame, attack_nodes: DataFrame) -> DataFrame:
    """(precision, detected): for each precision that a prefix of the ranking has, the largest share of attacks detected, in per cent; starts at (0, 0)."""
    total = attack_nodes.select("attack_id").distinct().count()
    run = running(results, attack_nodes).select((F.col("tp") / F.col("rank")).alias("precision"), (100.0 * F.col("attacks") / max(total, 1)).alias("detected"))
    start = results.sparkSession.createDataFrame([(0.0, 0.0)], "precision double, detected double")
    return run.unionByName(start).groupBy("precision").agg(F.max("detected").alias("detected"))


def recall_curve(results: DataFrame) -> DataFrame:
    total = results.agg(F.sum("y").alias("total"))
    run = running(results).join(F.broadcast(total), F.lit(True)).select((F.col("tp") / F.col("rank")).alias("precision"), (F.col("tp") / F.col("total")).alias("recall"))
    start = results.sparkSession.createDataFrame([(0.0, 0.0)], "precision double, recall double")
    return run.unionByName(start).groupBy("precision").agg(F.max("recall").alias("recall"))


def area(curve: DataFrame, x: str, y: str, divisor: float = 100.0) -> DataFrame:
    return trapezoids(curve, x, y).select(F.round(F.col("area") / divisor, 6).alias("area"))


def top_scores(results: DataFrame, k: int, y: int) -> DataFrame:
    """(r, score) of the k best rows of a class."""
    return results.where(F.col("y") == y).orderBy(*order()).limit(k).withColumn("r", F.row_number().over(W.orderBy(*order()))).select("r", "score")


def discrimination_area(results: DataFrame, k: int) -> DataFrame:
    """Area of the positive differences between the k best anomalous and the k best benign scores, by rank, over k times their range."""
    a, b = top_scores(results, k, 1).withColumnRenamed("score", "bad"), top_scores(results, k, 0).withColumnRenamed("score", "good")
    d = a.join(b, "r").withColumn("d", F.col("bad") - F.col("good"))
    reach = d.agg(F.greatest(F.max("bad"), F.max("good")) - F.least(F.min("bad"), F.min("good"))).first()[0] or 1.0
    kept = d.where("d > 0").withColumn("step", (F.col("d") + F.lag("d").over(W.orderBy("r"))) / 2)
    return kept.agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)) / (reach * k), 6).alias("area"))


def discrimination(results: DataFrame, attack_nodes: DataFrame, k: int = 10) -> DataFrame:
    """Per attack: its best score less the mean of the k best benign scores, over the best score of all."""
    benign = top_scores(results, k, 0).agg(F.avg("score").alias("benign"))
    top = results.agg(F.max("score").alias("top"))
    best = attack_nodes.withColumnRenamed("node_id", "node").join(results, "node").groupBy("attack_id").agg(F.max("score").alias("best"))
    return best.join(F.broadcast(benign.join(F.broadcast(top))), F.lit(True)).select("attack_id", F.round((F.col("best") - F.col("benign")) / F.col("top"), 6).alias("score"))


def zero_fp_prefix(results: DataFrame) -> DataFrame:
    """True positives before the first false positive. The first false positive is a minimum, not a sort."""
    first = results.where("y = 0").agg(F.max(F.struct("score", (-F.col("node")).alias("less"))).alias("fp"))
    above = results.where("y = 1").join(F.broadcast(first), F.lit(True)).where(F.col("fp").isNull() | (F.struct("score", (-F.col("node")).alias("less")) > F.col("fp")))
    return above.agg(F.count(F.lit(1)).alias("tps"))


def until_all_detected(results: DataFrame, attack_nodes: DataFrame) -> DataFrame:
    """False and true positives ranked before the node with which all attacks are detected (all rows if they never are)."""
    struct = F.struct("score", (-F.col("node")).alias("less"))
    hits = results.where("y = 1").join(attack_nodes.withColumnRenamed("node_id", "node"), "node").groupBy("attack_id").agg(F.max(struct).alias("first"))
    wanted = attack_nodes.select("attack_id").distinct().count()
    last = hits.agg(F.when(F.count(F.lit(1)) == wanted, F.min("first")).alias("last"))
    rows = results.join(F.broadcast(last), F.lit(True)).where(F.col("last").isNull() | (struct > F.col("last")))
    return rows.agg(F.count_if(F.col("y") == 0).alias("fps"), F.count_if(F.col("y") == 1).alias("tps"))


def dor_curve(results: DataFrame, points: int = 300) -> DataFrame:
    """(threshold, recall, dor) at equally spaced thresholds. Scores are counted by the interval they fall in, thresholds sum the intervals above: a row per threshold reaches the ordered window."""
    ends = results.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    k = F.least(F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / (points - 1))), F.lit(points - 1)).cast("int")
    binned = results.join(F.broadcast(ends), F.lit(True)).withColumn("k", k).groupBy("k").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    grid = results.sparkSession.range(points).select(F.col("id").cast("int").alias("k")).join(F.broadcast(ends), F.lit(True))
    up = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    g = grid.join(binned, "k", "left").withColumn("tp", F.sum(F.coalesce("p", F.lit(0))).over(up)).withColumn("fp", F.sum(F.coalesce("n", F.lit(0))).over(up))
    every = W.partitionBy()
    fn, tn = F.max("tp").over(every) - F.col("tp"), F.max("fp").over(every) - F.col("fp")
    return g.select("k", F.round(F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1), 6).alias("threshold"), F.round(F.col("tp") / (F.col("tp") + fn), 6).alias("recall"), F.round(F.col("tp") * tn / (F.col("fp") * fn + 1e-12), 3).alias("dor"))


def two_means_top(results: DataFrame, k: int) -> DataFrame:
    """(node, score, y_hat): the k best rows cut in two where the squared errors are least; the upper part is positive. Exact in one dimension, from prefix sums over k rows."""
    top = results.orderBy(*order()).limit(k)
    w = W.orderBy("score", F.desc("node"))
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    x = F.col("score")
    s = top.select("node", "score", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(up).alias("n1"), F.sum(x).over(up).alias("s1"), F.sum(x * x).over(up).alias("q1"), F.count(F.lit(1)).over(down).alias("n2"), F.sum(x).over(down).alias("s2"), F.sum(x * x).over(down).alias("q2"))
    error = (F.col("q1") - F.col("s1") * F.col("s1") / F.col("n1")) + (F.col("q2") - F.col("s2") * F.col("s2") / F.col("n2"))
    cut = s.where("n2 > 0").agg(F.min_by("i", F.struct(F.round(error, 9), "i")).alias("cut"))
    return s.join(F.broadcast(cut), F.lit(True)).select("node", "score", (F.col("i") > F.col("cut")).cast("int").alias("y_hat"))


def best_run(runs: DataFrame, run: str, *metrics: str) -> DataFrame:
    """The run with the largest metrics, compared in order; the first of equal ones."""
    key = F.struct(*metrics, (-F.col(run)).alias("__first"))
    return runs.agg(F.max_by(F.struct(run, *metrics), key).alias("best")).select("best.*")


def largest_jump(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The point before which y changes most."""
    jump = F.abs(F.col(y) - F.lag(y).over(W.orderBy(x)))
    return curve.select(x, y, jump.alias("jump")).where("jump IS NOT NULL").agg(F.max_by(F.struct(x, y, "jump"), F.struct("jump", -F.col(x))).alias("p")).select("p.*")

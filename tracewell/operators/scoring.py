"""From edge losses to scores of nodes and windows, thresholds and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.running import running

EPS = 1e-12
THRESHOLDS = {"max_val_loss": lambda x: F.max(x), "mean_val_loss": lambda x: F.avg(x), "90_percent_val_loss": lambda x: F.percentile(x, F.lit(0.9))}
FIXED_THRESHOLDS = {"threatrace": 1.5, "flash": 0.53}


def thresholds(losses: DataFrame) -> DataFrame:
    """One row of the thresholds that validation losses give."""
    return losses.agg(*(F.round(f("loss"), 6).alias("p90_val_loss" if k[0] == "9" else k) for k, f in THRESHOLDS.items()))


def node_losses(losses: DataFrame, use_dst: bool = True) -> DataFrame:
    """A row for each end of each edge (sources only without use_dst); a self loop counts twice."""
    ends = F.array("src", "dst") if use_dst else F.array("src")
    return losses.withColumn("node", F.explode(ends))


def reduce_losses(rows: DataFrame, *key: str, how: str = "max") -> DataFrame:
    return rows.groupBy(*key).agg((F.avg if how == "mean" else F.max)("loss").alias("score"))


def max_loss_window(rows: DataFrame) -> DataFrame:
    """(node, tw): the first window with the node's largest loss, or -1 if no loss is above 0."""
    best = F.max_by("tw", F.struct("loss", -F.col("tw")))
    return rows.groupBy("node").agg(F.when(F.max("loss") > 0, best).otherwise(-1).alias("tw"))


def confusion(rows: DataFrame, y: Column, y_hat: Column, *by: str) -> DataFrame:
    """tp, fp, tn, fn and what follows from them, per group or over all."""
    n = lambda c: F.count_if(c)
    base = rows.groupBy(*by).agg(n((y == 1) & (y_hat == 1)).alias("tp"), n((y == 0) & (y_hat == 1)).alias("fp"), n((y == 0) & (y_hat == 0)).alias("tn"), n((y == 1) & (y_hat == 0)).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    recall, precision, fpr = tp / (tp + fn + EPS), tp / (tp + fp + EPS), fp / (fp + tn + EPS)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    cols = {
        "precision": F.round(precision, 5), "recall": F.round(recall, 5), "fpr": F.round(fpr, 7), "fscore": F.round(2 * precision * recall / (precision + recall + EPS), 5),
        "accuracy": F.round((tp + tn) / (tp + tn + fp + fn + EPS), 5), "balanced_acc": F.round((recall + tn / (tn + fp + EPS)) / 2, 5),
        "lr_plus": F.round(recall / (fpr + EPS), 5), "dor": F.round(tp * tn / (fp * fn + EPS), 5), "mcc": F.round((tp * tn - fp * fn) / (root + EPS), 5),
    }
    return base.select(*by, "tp", "fp", "tn", "fn", *(v.alias(k) for k, v in cols.items()))


def score_groups(rows: DataFrame, score: str, y: str) -> DataFrame:
    """(score, pos, n, tp_up, n_up): counts per distinct score and of all scores at or above."""
    g = rows.groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    return running(g, [], [F.desc("score")], tp_up=F.col("pos"), n_up=F.col("n"))


def roc_auc(rows: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve as the rank statistic; ties count half."""
    g = score_groups(rows, score, y).withColumn("neg", F.col("n") - F.col("pos"))
    lost = F.sum(F.col("pos") * (F.col("n_up") - F.col("tp_up") - F.col("neg") / 2))  # negatives above, and half of equal ones
    every = F.sum("pos") * F.sum("neg")
    return g.agg(F.round((every - lost) / every, 6).alias("auc"))


def average_precision(rows: DataFrame, score: str, y: str) -> DataFrame:
    g = score_groups(rows, score, y)
    return g.agg(F.round(F.sum(F.col("pos") * F.col("tp_up") / F.col("n_up")) / F.sum("pos"), 6).alias("average_precision"))


def classified(rows: DataFrame) -> DataFrame:
    """rows (score, y, y_hat) with the class TP, FP, TN or FN."""
    c = F.when((F.col("y") == 1) & (F.col("y_hat") == 1), "TP").when(F.col("y_hat") == 1, "FP").when(F.col("y") == 1, "FN").otherwise("TN")
    return rows.withColumn("category", c)


def window_anomalies(losses: DataFrame, factor: float = 1.5) -> DataFrame:
    """Per window: threshold mean + factor * deviation, edges above it, their mean loss, their nodes and distinct edges."""
    levels = losses.groupBy("tw").agg((F.avg("loss") + factor * F.stddev_pop("loss")).alias("threshold"))
    return over_threshold(losses.join(levels, "tw"))


def over_threshold(rows: DataFrame) -> DataFrame:
    """The same with column threshold given. Windows without an edge above have zeros."""
    over = F.col("loss") > F.col("threshold")
    hot = rows.where(over)
    stats = rows.groupBy("tw").agg(F.round(F.first("threshold"), 6).alias("threshold"), F.count_if(over).alias("n"), F.round(F.coalesce(F.avg(F.when(over, F.col("loss"))), F.lit(0.0)), 6).alias("mean_loss"))
    nodes = hot.select("tw", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("tw").agg(F.count(F.lit(1)).alias("nodes"))
    edges = hot.select("tw", "src", "dst", "op").distinct().groupBy("tw").agg(F.count(F.lit(1)).alias("edges"))
    return stats.join(nodes, "tw", "left").join(edges, "tw", "left").na.fill(0, ["nodes", "edges"])


def class_weights(rows: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """total / (K * count) for each class of the catalogue, 0 for absent ones."""
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    k, total = classes.count(), F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy())
    return classes.join(n, column, "left").select(column, F.round(F.when(F.col("n").isNull(), 0.0).otherwise(total / (k * F.col("n"))), 6).alias("weight"))


def fp_share_in(results: DataFrame, labelled_windows: DataFrame) -> DataFrame:
    """Of false positives, the share whose window of largest loss is labelled; NaN if there are none."""
    fp = results.where("y = 0 AND y_hat = 1").join(labelled_windows.select("tw").distinct().withColumn("hit", F.lit(1.0)), "tw", "left")
    return fp.agg(F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(float("nan"))), 6).alias("share"))


def detected_attacks(results: DataFrame, attack_nodes: DataFrame) -> DataFrame:
    """Per attack: true positives and malicious nodes."""
    hits = attack_nodes.join(results.select(F.col("node").alias("node_id"), "y_hat"), "node_id", "left")
    return hits.groupBy("attack_id").agg(F.coalesce(F.sum("y_hat"), F.lit(0)).cast("long").alias("tps"), F.count(F.lit(1)).alias("nodes"))


def run_stats(runs: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean, deviation and deviation in per cent of the mean for each metric over runs."""
    std, mean = F.stddev_pop(value), F.avg(value)
    return runs.groupBy(metric).agg(F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"), F.round(std / (mean + EPS) * 100, 6).alias("rel_std"))


# losses of single rows, on arrays


def mse(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mae(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def sce(a: str, b: str, alpha: int = 3) -> Column:
    """(1 - cosine)^alpha"""
    return F.pow(1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), F.lit(alpha))


def cross_entropy(logits: str, target: str) -> Column:
    top = F.array_max(logits)
    return F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - F.get(logits, F.col(target))


def threatrace_score(probabilities: str) -> Column:
    """ln of the two largest probabilities' ratio; a second of 0 counts as 1e-5, results below 0 as 0."""
    p = F.sort_array(probabilities, asc=False)
    second = F.when(F.get(p, 1) == 0, 1e-5).otherwise(F.get(p, 1))
    return F.greatest(F.log(F.get(p, 0) / second), F.lit(0.0))


def flash_confidence(logits: str) -> Column:
    o = F.sort_array(logits, asc=False)
    return (F.get(o, 0) - F.get(o, 1)) / (F.get(o, 0) + 1e-6)

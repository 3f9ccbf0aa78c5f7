"""Rare nodes, and queues of windows that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.running import numbered, running
from tracewell.operators.storage import written


def idf(members: DataFrame, item: str = "node", window: str = "tw") -> DataFrame:
    """(item, df, idf): ln(windows / (df + 1))."""
    total = members.agg(F.count_distinct(window).alias("total"))
    df = members.groupBy(item).agg(F.count_distinct(window).alias("df"))
    return df.join(F.broadcast(total), F.lit(True)).select(item, "df", F.round(F.log(F.col("total") / (F.col("df") + 1)), 6).alias("idf"))


def related_windows(members: DataFrame, rare: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of windows, a < b, with the number of rare nodes in both. A node in w windows gives w(w-1)/2 pairs before they are counted: what is called rare should be in few windows. ``chained_windows`` does without."""
    rows = members.select("tw", "node").distinct().join(rare.select("node"), "node", "left_semi")
    return rows.select("node", F.col("tw").alias("a")).join(rows.select("node", F.col("tw").alias("b")), "node").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def chained_windows(members: DataFrame, rare: DataFrame) -> DataFrame:
    """(a, b): each window with the window before it that has one of its rare nodes. A row for each rare node and window at most; for queues as good as all related pairs, since a window's queue is never later than that of a related window before it."""
    rows = members.select("tw", "node").distinct().join(rare.select("node"), "node", "left_semi")
    before = running(rows, ["node"], ["tw"], "max", True, a=F.col("tw"))
    return before.where("a IS NOT NULL").select("a", F.col("tw").alias("b")).distinct()


def queues(windows: DataFrame, related: DataFrame) -> DataFrame:
    """(queue, tw): in order, each window joins the first queue that has a related window before it, or opens one; queues are numbered in the order of their first windows.

    A window's queue is that of the earliest window which it reaches along pairs (a, b), a < b, going back. Labels are iterated: each round every window takes the least label among
    its earlier related windows and the label of its own label, until nothing changes. No group is folded anywhere.
    """
    links = written(related.select("a", "b").distinct(), "links")
    label = written(links.groupBy(F.col("b").alias("tw")).agg(F.min("a").alias("first")), "labels")
    while True:
        near = links.join(label.select(F.col("tw").alias("a"), "first"), "a").groupBy(F.col("b").alias("tw")).agg(F.min("first").alias("near"))
        new = label.join(near, "tw", "left").select("tw", F.least("first", "near").alias("first"), F.col("first").alias("old"))
        jump = new.join(label.select(F.col("tw").alias("first"), F.col("first").alias("further")), "first", "left")
        now = written(jump.select("tw", F.least("first", "further").alias("first"), "old"), "labels")
        label = now.select("tw", "first")
        if now.where("first != old").isEmpty():
            break
    members = windows.select("tw").distinct().join(label, "tw", "left").select(F.coalesce("first", "tw").alias("first"), "tw")
    members = written(members, "queues")
    numbers = numbered(members.select("first").distinct(), [], ["first"], "queue")
    return members.join(numbers, "first").select((F.col("queue") - 1).alias("queue"), "tw")


def queue_scores(members: DataFrame, losses: DataFrame) -> DataFrame:
    """(queue, score): the product of loss + 1 over a queue's windows, as a sum of logarithms."""
    return members.join(losses, "tw").groupBy("queue").agg(F.round(F.exp(F.sum(F.log(F.col("loss") + 1))), 4).alias("score"))


def flagged_windows(members: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    return members.join(scores, "queue").select("tw", (F.col("score") > threshold).cast("int").alias("y_hat"))

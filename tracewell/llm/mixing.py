"""Mixing sources to target weights by entropy balancing.

Among all rates r_i of documents (expected copies, at most CAP) that give each source its target of words, the ones of
largest entropy are exponentially tilted: r_i = min(CAP, exp(lambda_s * size_i / mean size_s)). lambda solves the convex dual
of the token constraints. Its gradient and curvature are sums over documents, taken as one distributed
aggregate per Newton step over the exact histogram (source, size, count); steps that leave the bracket known so far are
replaced by bisection. Rates are rounded into copies by systematic sampling: within a source, ordered by size, copies are drawn where the
running sum of fractional parts passes an integer, so a source's words miss its target by about one document;
a few draws are then turned round to close that gap.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, materialise

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
TOLERANCE, STEPS = 1e-7, 60
#: Equal (source, size) pairs are dealt to groups of about so many documents, and so many groups of a pair share a subtotal of the running sum.
GROUP, BLOCK = 2000, 1000
#: Turns of single draws end when each source is this near its target, or after so many rounds; documents are swapped so many times.
NEAR, ROUNDS, SWAPS = 0.002, 8, 2
#: What a draw is known by.
DRAW = ["sid", "size", "part", "k"]


def source_targets(narrow: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, sid, n, source_size, target): weights repeat over the sources in code-point order, null last; no target is above cap times its source's size, and what is above goes to the others by weight. The unpartitioned windows see one row per source."""
    sources = narrow.groupBy("source").agg(F.count_if(F.col("size") > 0).alias("n"), F.sum("size").alias("source_size"))
    ranked = sources.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("top", cap * F.col("source_size"))
    every, by_ratio = W.partitionBy(), W.orderBy(F.col("top") / F.col("w"), "sid")
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    full = ranked.withColumn("full", F.col("top") / F.col("w") < level)
    rest = (share * F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("top")).otherwise(0.0)).over(every)) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    return full.select("source", "sid", "n", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.least("top", rest * F.col("w"))).alias("target"))


def newton(histogram: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """(sid, lam): the dual solution of each source; null where every document is taken cap times."""
    start = sources.where("source_size > 0").select("sid", (F.col("source_size") / F.col("n")).alias("mean"), "target", F.when(F.col("target") < cap * F.col("source_size") * (1 - TOLERANCE), F.lit(0.0)).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("miss"))
    state = materialise(start, "dual")
    for _ in range(STEPS):
        z, words = F.col("size") / F.col("mean"), F.col("n") * F.col("size")
        tilt = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
        sums = histogram.join(bounded(state), "sid").groupBy("sid", "mean", "target", "lam", "lo", "hi").agg(
            F.sum(words * F.least(tilt, F.lit(cap))).alias("got"), F.sum(F.when(tilt < cap, words * z * tilt).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        now = sums.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi")))
        reach = 2 * (1 + F.abs("lam"))
        step = F.greatest(F.least(F.when(F.col("slope") > 0, -gap / F.col("slope")).otherwise(-F.signum(gap) * reach), reach), -reach)
        new, inside = F.col("lam") + step, (F.col("lo") + F.col("hi")) / 2
        new = F.when((new > F.col("lo")) & (new < F.col("hi")), new).otherwise(inside)
        miss = F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0))
        now = now.select("sid", "mean", "target", F.when(miss <= TOLERANCE, F.col("lam")).otherwise(new).alias("lam"), "lo", "hi", miss.alias("miss"))
        state = materialise(now, "dual")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        warnings.warn(f"after {STEPS} steps the rates of some source miss its target by more than {TOLERANCE}", stacklevel=2)
    return state.select("sid", "lam", "mean")


def summed_before(groups: DataFrame) -> DataFrame:
    """groups with the sum of x over those before them in their source, by size and part. In two levels: no task sees more than a size's BLOCK groups, or a source's subtotals."""
    groups = groups.withColumn("block", F.floor(F.col("part") / BLOCK).cast("int"))
    upto = lambda w: F.coalesce(F.sum("x").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    totals = groups.groupBy("sid", "size", "block").agg(F.sum("x").alias("x"))
    totals = materialise(totals.select("sid", "size", "block", upto(W.partitionBy("sid").orderBy("size", "block")).alias("base")), "subtotals")
    within = groups.withColumn("inner", upto(W.partitionBy("sid", "size", "block").orderBy("part")))
    return within.join(bounded(totals), ["sid", "size", "block"]).withColumn("before", F.col("base") + F.col("inner")).drop("base", "inner", "block", "x")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken.

    Sizes are words between ASCII white space; null and blank texts have size 0, one copy and nothing taken. Null is a source
    of its own, the last. Draws depend on size, source and a hash of the id, so reruns agree; rows equal in all three
    are interchangeable. Other columns are not looked at; an empty table gives an empty result.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    narrow = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size.alias("size")), "sizes")
    sources = materialise(source_targets(narrow, weights, share, cap), "sources")
    named = narrow.withColumnRenamed("source", "__source").join(bounded(sources), F.col("__source").eqNullSafe(F.col("source"))).select("doc_id", "size", "sid", "source_size", "target")
    histogram = materialise(named.groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    dual = newton(histogram.where("size > 0"), sources, cap)
    dealt = named.join(bounded(histogram), ["sid", "size"]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.ceil(F.col("n") / GROUP)).cast("int")).drop("n")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), cap).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))))
    groups = dealt.groupBy("sid", "size", "part").agg(F.count(F.lit(1)).alias("n")).join(bounded(dual), "sid", "left")
    groups = groups.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("rest", F.col("rate") - F.col("whole"))
    groups = materialise(summed_before(groups.withColumn("x", F.col("n") * F.col("rest"))).select("sid", "size", "part", "whole", "rest", (F.col("before") + 0.5).alias("before")), "rates")
    k = F.row_number().over(W.partitionBy("sid", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = dealt.join(bounded(groups), ["sid", "size", "part"]).withColumn("k", k)
    extra = F.floor(F.col("before") + F.col("rest") * F.col("k")) - F.floor(F.col("before") + F.col("rest") * (F.col("k") - 1))
    drawn = materialise(drawn.select("doc_id", "sid", "size", "part", "k", "source_size", "target", "whole", (F.col("rest") > 0).alias("open"), extra.alias("extra")), "drawn")
    return settle(drawn).select("doc_id", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"))


def turned_copies(drawn: DataFrame, turned: DataFrame | None) -> DataFrame:
    """drawn with column copies, after the draws listed in turned (as often as there) are turned round."""
    if turned is None:
        return drawn.withColumn("copies", F.col("whole") + F.col("extra"))
    odd = F.pmod(F.coalesce(F.col("turns"), F.lit(0)), F.lit(2)) == 1
    now = drawn.join(bounded(turned), DRAW, "left").withColumn("extra", F.when(odd, 1 - F.col("extra")).otherwise(F.col("extra"))).drop("turns")
    return now.withColumn("copies", F.col("whole") + F.col("extra"))


def missing(now: DataFrame) -> DataFrame:
    """(sid, miss, aim): what each source lacks of its target."""
    return materialise(now.groupBy("sid").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss"), F.first("target").alias("aim")), "miss")


def able_to(now: DataFrame, wide: DataFrame) -> DataFrame:
    """The draws of the sources in wide that bring them nearer to the target, with the gap."""
    return now.join(bounded(wide), "sid").where(F.col("open") & (F.col("extra") == (F.col("miss") < 0).cast("int"))).withColumn("gap", F.abs("miss"))


def added(turned: DataFrame | None, new: DataFrame) -> DataFrame:
    new = new.withColumn("turns", F.lit(1))
    every = new if turned is None else new.unionByName(turned)
    return materialise(every.groupBy(*DRAW).agg(F.sum("turns").cast("int").alias("turns")), "turned")


def greedy(drawn: DataFrame, turned: DataFrame | None, sources: DataFrame | None, rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """turned, and what is then missing, after so many rounds. In each, draws are turned from the largest documents that fit into a source's gap down, until the next would not fit; when none fits, the one that comes nearest closes the
    gap as far as it goes. Which sizes are turned, and how many of each, comes from a histogram. Only the given sources are looked at."""
    last = False
    for turn in range(rounds + 1):
        now = turned_copies(drawn, turned)
        miss = missing(now)
        wide = miss.where(F.abs("miss") > NEAR * F.col("aim"))
        wide = materialise(wide if sources is None else wide.join(bounded(sources), "sid", "left_semi"), "wide")
        if last or turn == rounds or not wide.count():
            return turned, miss
        able = able_to(now, wide)
        sizes = able.where("size <= gap").groupBy("sid", "size", "gap").agg(F.count(F.lit(1)).alias("n"))
        larger = F.coalesce(F.sum(F.col("n") * F.col("size")).over(W.partitionBy("sid").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        plan = sizes.withColumn("take", F.least("n", F.floor((F.col("gap") - larger) / F.col("size")))).where("take > 0").select("sid", "size", "take")
        plan = materialise(plan, "turns")
        if plan.count():
            fit = able.join(bounded(plan), ["sid", "size"])
            parts = fit.groupBy("sid", "size", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each group of documents
            ahead = F.coalesce(F.sum("n").over(W.partitionBy("sid", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            parts = materialise(parts.select("sid", "size", "part", ahead.alias("ahead")), "ahead")
            rank = F.col("ahead") + F.row_number().over(W.partitionBy("sid", "size", "part").orderBy("k"))
            new = fit.join(bounded(parts), ["sid", "size", "part"]).withColumn("rank", rank).where("rank <= take").select(*DRAW)
        else:
            after = F.abs(F.col("size") - F.col("gap"))
            new = able.where(after < F.col("gap")).groupBy("sid").agg(F.min(F.struct(after.alias("after"), "size", "part", "k")).alias("best")).select("sid", "best.size", "best.part", "best.k")
            last = True
        turned = added(turned, new)
    raise AssertionError


def settle(drawn: DataFrame, rounds: int = ROUNDS, swaps: int = SWAPS) -> DataFrame:
    """drawn with a column copies. What a source misses its target by after the draws is about a document; draws are turned round to close that gap (``greedy``).

    Where nothing smaller than the gap is left to turn, documents are swapped: the smallest draw beyond the gap is turned although it overshoots, and others are turned
    back into the new gap; a source keeps that only if it ends nearer. Sources that stay off by more than NEAR are reported by a warning.
    """
    turned, miss = greedy(drawn, None, None, rounds)
    for _ in range(swaps):
        wide = materialise(miss.where(F.abs("miss") > NEAR * F.col("aim")), "wide")
        if not wide.count():
            break
        beyond = able_to(turned_copies(drawn, turned), wide).where("size > gap").groupBy("sid").agg(F.min(F.struct("size", "part", "k")).alias("best"))
        beyond = materialise(beyond.select("sid", "best.size", "best.part", "best.k"), "beyond")
        if not beyond.count():
            break
        tried, left = greedy(drawn, added(turned, beyond), beyond.select("sid"), rounds)
        nearer = left.join(miss.select("sid", F.col("miss").alias("before")), "sid").where(F.abs("miss") < F.abs("before")).select("sid")
        nearer = materialise(nearer, "nearer")
        if not nearer.count():
            break
        better = tried.join(bounded(nearer), "sid", "left_semi")
        if turned is not None:
            better = better.unionByName(turned.join(bounded(nearer), "sid", "left_anti"))
        turned = materialise(better, "turned")
        miss = missing(turned_copies(drawn, turned))
    off = miss.where(F.abs("miss") > NEAR * F.col("aim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("miss") / F.col("aim")).alias("most")).first()
    if off.n:
        warnings.warn(f"{off.n} sources miss their targets by more than {NEAR:.1%}, at most by {off.most:.2%}: their documents are too large to come nearer", stacklevel=2)
    return turned_copies(drawn, turned)


def mixture(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with each row as often as the mix takes it; column ``copy`` (in place of one of that name) numbers its copies from 1. Rows that repeat an id, or have none, get the most copies that one of them draws; an empty table stays empty."""
    drawn = mix(docs, text, source, id_col).groupBy("doc_id").agg(F.max("copies").alias("__copies")).withColumnRenamed("doc_id", "__id")
    rows = docs.join(bounded(materialise(drawn.where("__copies > 0"), "copies")), F.col(id_col).eqNullSafe(F.col("__id")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "__copies"))).drop("__id", "__copies")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")

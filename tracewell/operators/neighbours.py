"""Exact nearest neighbours by a pivot index, and local outlier factors on top of them.

Equal vectors are collapsed to one with a count, so a crowd of copies costs what one vector does. A bounded sample of pivots divides the
rest into cells, each point with its distance to its pivot. From the cells' radii and counts alone a query knows a bound of its k-th distance; by the triangle inequality
it then visits only cells that can hold points within. Cells are met in tiles of bounded size, and of a tile only the nearest of each query leave it. Nothing is approximate: with
vectors without structure more cells are visited, never fewer neighbours found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.storage import bounded, written
from tracewell.operators.tiles import tiled

PIVOTS, SLACK = 32, 1e-9
#: Rows of either side of a tile, about.
TILE = 16_384


def collapsed(rows: DataFrame, axes: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rep, axes, n), one row for each distinct vector under its least id, and (id, rep). Rows with a null on an axis are left out."""
    fine = rows.dropna(subset=axes)
    points = written(fine.groupBy(*axes).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    return points, written(fine.select(id_col, *axes).join(bounded(points.select("rep", *axes)), axes).select(id_col, "rep"), "members")


def _distance(a: list[Column], b: list[Column]) -> Column:
    return F.round(F.sqrt(reduce(Column.__add__, ((x - y) * (x - y) for x, y in zip(a, b, strict=True)))), 9)


def nearest(queries: DataFrame, points: DataFrame, axes: list[str], k: int, own: bool, pivots: int = PIVOTS) -> DataFrame:
    """(q, p, dist, take): of each query (rep, axes) the nearest points (rep, axes, n), copies counted, until there are k: take of p's copies are among them. Ties go to the smaller rep. With ``own`` the queries are points themselves and leave out one copy of themselves."""
    chosen = points.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select(*axes).collect()
    if not chosen:
        return queries.select(F.col("rep").alias("q"), F.col("rep").alias("p"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("take")).where("false")
    far = F.array(*(_distance([F.col(c) for c in axes], [F.lit(float(v)) for v in r]) for r in chosen))
    placed = points.withColumn("far", far).withColumn("cell", (F.array_position("far", F.array_min("far")) - 1).cast("int"))
    placed = written(placed.select(F.col("rep").alias("p"), *(F.col(c).alias(f"p_{c}") for c in axes), "n", "cell", F.array_min("far").alias("p_far")), "cells")
    cells = {r.cell: (r.radius, r.n, -(-r.rows // TILE)) for r in placed.groupBy("cell").agg(F.max("p_far").alias("radius"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}  # a row for each pivot
    known = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(cells[i][0])).alias("radius"), F.lit(int(cells[i][1])).alias("n"), F.lit(cells[i][2]).alias("blocks")) for i in sorted(cells)))
    rows = queries.select(F.col("rep").alias("q"), *axes, far.alias("far"))
    reach = F.array_sort(F.transform(known, lambda c: F.struct((F.get("far", c["i"]) + c["radius"]).alias("d"), c["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("d"))
    within = F.aggregate(reach, start, lambda s, c: F.when(s["n"] >= k + own, s).otherwise(F.struct((s["n"] + c["n"].cast("long")).alias("n"), c["d"].alias("d"))))
    rows = rows.withColumn("bound", F.when(within["n"] >= k + own, within["d"] + SLACK).otherwise(F.lit(float("inf"))))
    visits = F.filter(known, lambda c: F.get("far", c["i"]) - c["radius"] <= F.col("bound"))
    parts = max(1, -(-queries.count() // TILE))
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    vector = lambda names: F.array(*(F.col(c).cast("double") for c in names))
    a = rows.select("q", vector(axes).alias("qv"), deal("q", F.lit(parts)).alias("part"), F.explode(visits).alias("v"))
    a = a.select("q", "qv", "part", F.col("v.i").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("v.blocks") - 1)).alias("block"))
    blocks = F.element_at(F.create_map(*(F.lit(x) for i in sorted(cells) for x in (i, cells[i][2]))), F.col("cell"))
    b = placed.select("p", vector([f"p_{c}" for c in axes]).alias("pv"), "n", "cell", deal("p", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = written(tiled(a, b, ["cell", "block", "part"], k, own, 9), "met")

    def first(rows: DataFrame, *by: str) -> DataFrame:
        before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("dist", "p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return rows.withColumn("before", before).where(F.col("before") < k)

    best = first(met, "q")
    return written(best.select("q", "p", "dist", F.least("n", F.lit(k) - F.col("before")).alias("take")), "nearest")


def local_outlier_factors(points: DataFrame, queries: DataFrame, axes: list[str], id_col: str, k: int = 30, pivots: int = PIVOTS) -> DataFrame:
    """(id, lof) of queries against points, as novelty: the mean local reachability density of a query's k nearest points over its own. About 1 amid points like it, larger outside.

    A point's density is one over the mean of its reach distances to its k nearest other points (its distance, but no less than the other's own k-th distance), plus 1e-10, so that
    copies have a finite one. With fewer than k points all of them are neighbours. Queries with a null on an axis are left out.
    """
    base, _ = collapsed(points, axes, id_col)
    asked, members = collapsed(queries, axes, id_col)
    near = nearest(base, base, axes, k, True, pivots)
    last = written(near.groupBy("q").agg(F.max("dist").alias("k_dist")), "k-distances").select(F.col("q").alias("p"), "k_dist")

    def density(pairs: DataFrame) -> DataFrame:
        reach = pairs.join(bounded(last), "p").withColumn("reach", F.greatest("dist", "k_dist"))
        return written(reach.groupBy("q").agg((1 / (F.sum(F.col("take") * F.col("reach")) / F.sum("take") + 1e-10)).alias("lrd")), "densities")

    own = density(near)
    met = nearest(asked, base, axes, k, False, pivots)
    lrd = density(met)
    mean = met.join(bounded(own.select(F.col("q").alias("p"), "lrd")), "p").groupBy("q").agg((F.sum(F.col("take") * F.col("lrd")) / F.sum("take")).alias("mean"))
    scores = written(mean.join(lrd, "q").select(F.col("q").alias("rep"), (F.col("mean") / F.col("lrd")).alias("lof")), "outliers")
    return members.join(bounded(scores), "rep").select(id_col, "lof")

"""Queries over outlying nodes, with brute force as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import neighbours, queues
from tracewell.plans.catalogue import WITH, query, test_members
from tracewell.sources import adapters as a

K = 20
OUTLYING = 1.5
SIDES = [(end, op) for end in ("src", "dst") for op in a.OPS.values()]
AXES = [f"v{i}" for i in range(len(SIDES))]


def shares(e):
    """(node, axes): the share of each end and operation in a node's events."""
    ends = e.select(F.col("src").alias("node"), F.lit("src").alias("end"), "op").unionByName(e.select(F.col("dst").alias("node"), F.lit("dst").alias("end"), "op"))
    counts = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *(F.count_if((F.col("end") == end) & (F.col("op") == op)).alias(v) for v, (end, op) in zip(AXES, SIDES, strict=True)))
    return counts.select("node", *(F.round(F.col(v) / F.col("n"), 6).alias(v) for v in AXES))


def factors(spark, d):
    e = a.losses(spark, d)
    return neighbours.local_outlier_factors(shares(e.where("split != 'test'")), shares(e.where("split = 'test'")), AXES, "node", K)


def _shares_sql(where: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE side = '{end}' AND op = '{op}') AS c{i}" for i, (end, op) in enumerate(SIDES))
    return f"SELECT node, {', '.join(f'round(c{i} / n, 6) AS v{i}' for i in range(len(AXES)))} FROM (SELECT node, count(*) AS n, {counts} FROM (SELECT src AS node, 'src' AS side, op FROM losses WHERE {where} UNION ALL SELECT dst, 'dst', op FROM losses WHERE {where}) GROUP BY node)"


DIST = "round(sqrt(" + " + ".join(f"(x.{v} - y.{v}) * (x.{v} - y.{v})" for v in AXES) + "), 9)"
LOF = WITH + a.LOSSES + f""", base0 AS ({_shares_sql("split <> 'test'")}), base AS MATERIALIZED (SELECT *, min(node) OVER (PARTITION BY {", ".join(AXES)}) AS rep FROM base0), asked AS MATERIALIZED ({_shares_sql("split = 'test'")}),
pp AS (SELECT x.node AS q, y.node AS p, {DIST} AS d, y.rep FROM base x JOIN base y ON x.node <> y.node), pn AS MATERIALIZED (SELECT q, p, d FROM pp QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, rep, p) <= {K}),
kd AS MATERIALIZED (SELECT q AS p, max(d) AS k_dist FROM pn GROUP BY q), lrd AS MATERIALIZED (SELECT q AS p, 1 / (avg(greatest(d, k_dist)) + 1e-10) AS lrd FROM pn JOIN kd USING (p) GROUP BY q),
qp AS (SELECT x.node AS q, y.node AS p, {DIST} AS d, y.rep FROM asked x JOIN base y ON true), qn AS MATERIALIZED (SELECT q, p, d FROM qp QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, rep, p) <= {K}),
lof AS MATERIALIZED (SELECT q AS node, avg(lrd) * (avg(greatest(d, k_dist)) + 1e-10) AS lof FROM qn JOIN kd USING (p) JOIN lrd USING (p) GROUP BY q)"""


@query(LOF + " SELECT node, round(lof, 5) AS lof FROM lof")
def outlier_factors(spark, d):
    return factors(spark, d).select("node", F.round("lof", 5).alias("lof"))


@query(LOF + f""", m AS (SELECT DISTINCT tw, unnest([src, dst]) AS node FROM losses WHERE split = 'test'), rr AS (SELECT m.* FROM m JOIN lof USING (node) WHERE round(lof, 5) > {OUTLYING}), rel AS MATERIALIZED (SELECT DISTINCT x.tw AS a, y.tw AS b FROM rr x JOIN rr y ON x.node = y.node AND x.tw < y.tw),
back(tw, first) AS (SELECT tw, tw FROM m UNION SELECT k.tw, rel.a FROM back k JOIN rel ON rel.b = k.first), qs AS (SELECT tw, min(first) AS first FROM back GROUP BY tw) SELECT dense_rank() OVER (ORDER BY first) - 1 AS queue, tw FROM qs""")
def outlier_queues(spark, d):
    m = test_members(spark, d)
    odd = factors(spark, d).where(F.round("lof", 5) > OUTLYING)
    return queues.queues(m, queues.chained_windows(m, odd))

"""Queries over the time series of edges: mixtures, bandwidths and grids, from whole histograms. Numbers of rounds are parameters of the queries, so that SQL can unroll them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.special import BERNOULLI, SHIFT
from tracewell.operators import mixtures as m
from tracewell.operators import windows
from tracewell.plans.catalogue import WITH, query
from tracewell.sources import adapters as a

KEY = ("src", "op")
MOST, CLUSTER_ROUNDS, ROUNDS, COMPONENTS = 4, 3, 3, 5


def gap_hours(spark, d):
    return windows.gaps(a.prov(spark, d).select("src", "op", "t", "event_uuid", "day"), *KEY).select(*KEY, "t", (F.col("gap") / 3.6e12).alias("gap"))


def fitted(spark, d, tolerance=0.0):
    return m.mixtures(gap_hours(spark, d), "gap", *KEY, most=MOST, cluster_rounds=CLUSTER_ROUNDS, rounds=ROUNDS, tolerance=tolerance)


def listed(rows, *more):
    """A row for each component."""
    return rows.select(*KEY, *more, F.posexplode("mixture").alias("component", "c")).select(*KEY, *more, "component", F.round("c.mean", 4).alias("mean"), F.round("c.var", 4).alias("var"), F.round("c.weight", 5).alias("weight"))


# The SQL twins: hours between events of (src, op), counted; each round is a step of its own.

HOURS = a.PROV + ", g AS MATERIALIZED (SELECT src, op, t, (t - lag(t) OVER (PARTITION BY src, op ORDER BY t, event_uuid)) / 3.6e12 AS x FROM prov)"
HIST = HOURS + ", h AS MATERIALIZED (SELECT src, op, x, CAST(count(*) AS DOUBLE) AS n FROM g WHERE x IS NOT NULL GROUP BY ALL)"


def stats_sql(h: str = "h", tag: str = "") -> str:
    return f""", st0{tag} AS (SELECT src, op, sum(n) AS total, count(*) AS dist, sum(n * x) / sum(n) AS m FROM {h} GROUP BY ALL),
st{tag} AS MATERIALIZED (SELECT src, op, any_value(total) AS total, any_value(dist) AS dist, any_value(m) AS m, sum(n * (x - m) * (x - m)) / any_value(total) AS v FROM {h} JOIN st0{tag} USING (src, op) GROUP BY ALL),
c{tag} AS MATERIALIZED (SELECT src, op, x - m AS x, n FROM {h} JOIN st{tag} USING (src, op))"""


PART = "sum(n * x) / sum(n) AS mean, greatest(sum(n * x * x) / sum(n) - (sum(n * x) / sum(n)) ** 2, 0) AS var, sum(n) AS weight, greatest(sum(n * x * x) - sum(n * x) * (sum(n * x) / sum(n)), 0) AS inertia"


def mixture_sql(tag: str = "", most: int = MOST, cluster_rounds: int = CLUSTER_ROUNDS, rounds: int = ROUNDS) -> str:
    """CTEs up to mix{tag}(src, op, n, component, mean, var, weight)."""
    out = f""", cum{tag} AS (SELECT src, op, x, n, total, dist, sum(n) OVER (PARTITION BY src, op ORDER BY x) AS upto FROM c{tag} JOIN st{tag} USING (src, op)),
lab{tag} AS (SELECT src, op, k, x, n, floor(k * (upto - n / 2) / total + 1e-9) AS label FROM cum{tag}, range(1, {most + 1}) r(k) WHERE k <= dist),
p{tag}_0 AS MATERIALIZED (SELECT src, op, k, {PART} FROM lab{tag} GROUP BY src, op, k, label)"""
    for i in range(cluster_rounds):
        out += f""", z{tag}_{i} AS (SELECT c.src, c.op, p.k, c.x, c.n, p.mean, abs(c.x - p.mean) AS d, min(abs(c.x - p.mean)) OVER (PARTITION BY c.src, c.op, p.k, c.x) AS least FROM c{tag} c JOIN p{tag}_{i} p USING (src, op)),
q{tag}_{i} AS (SELECT src, op, k, x, any_value(n) AS n, min(mean) AS near FROM z{tag}_{i} WHERE d <= least * (1 + 1e-9) GROUP BY src, op, k, x),
p{tag}_{i + 1} AS MATERIALIZED (SELECT src, op, k, {PART} FROM q{tag}_{i} GROUP BY src, op, k, near)"""
    last = f"p{tag}_{cluster_rounds}"
    out += f""", fall{tag} AS (SELECT src, op, k, coalesce(lag(i) OVER (PARTITION BY src, op ORDER BY k) - i, -1) AS fall FROM (SELECT src, op, k, sum(inertia) AS i FROM {last} GROUP BY ALL)),
best{tag} AS (SELECT src, op, min(k) AS k FROM (SELECT *, max(fall) OVER (PARTITION BY src, op) AS steepest FROM fall{tag}) WHERE fall >= steepest - 1e-9 * abs(steepest) GROUP BY ALL),
e{tag}_0 AS MATERIALIZED (SELECT p.src, p.op, row_number() OVER (PARTITION BY p.src, p.op ORDER BY mean) - 1 AS k, mean, greatest(var, 1e-10 * greatest(1, v) + 1e-12) AS var, weight / total AS weight
  FROM {last} p JOIN best{tag} b ON b.src = p.src AND b.op = p.op AND p.k = b.k JOIN st{tag} s ON s.src = p.src AND s.op = p.op)"""
    for i in range(rounds):
        out += f""", l{tag}_{i} AS (SELECT c.src, c.op, c.x, c.n, k, ln(greatest(weight, 1e-300)) - 0.5::DOUBLE * ln(2 * pi() * var) - (c.x - mean) * (c.x - mean) / (2 * var) AS p FROM c{tag} c JOIN e{tag}_{i} USING (src, op)),
t{tag}_{i} AS (SELECT *, max(p) OVER (PARTITION BY src, op, x) AS top FROM l{tag}_{i}),
r{tag}_{i} AS (SELECT src, op, k, x, n * exp(p - top) / sum(exp(p - top)) OVER (PARTITION BY src, op, x) AS r FROM t{tag}_{i}),
e{tag}_{i + 1} AS MATERIALIZED (SELECT src, op, k, s1 / greatest(s0, 1e-300) AS mean, greatest(s2 / greatest(s0, 1e-300) - (s1 / greatest(s0, 1e-300)) ** 2, 1e-10 * greatest(1, v) + 1e-12) AS var, s0 / total AS weight
  FROM (SELECT src, op, k, sum(r) AS s0, sum(r * x) AS s1, sum(r * x * x) AS s2 FROM r{tag}_{i} GROUP BY ALL) JOIN st{tag} USING (src, op))"""
    return out + f""", mix{tag} AS MATERIALIZED (SELECT src, op, total AS n, row_number() OVER (PARTITION BY src, op ORDER BY mean + m, var, weight) - 1 AS component, mean + m AS mean, var, weight FROM e{tag}_{rounds} JOIN st{tag} USING (src, op))"""


MIX = WITH + HIST + stats_sql() + mixture_sql()
SHOWN = "CAST(component AS INTEGER) AS component, round(mean, 4) AS mean, round(var, 4) AS var, round(weight, 5) AS weight"


@query(MIX + f" SELECT src, op, n, {SHOWN} FROM mix")
def gap_mixtures(spark, d):
    return listed(fitted(spark, d), "n")


@query(MIX + """, k AS (SELECT src, op, any_value(n) AS n, count(*) AS k FROM mix GROUP BY ALL)
SELECT count(*) AS edges, sum(n) AS times, CAST(sum(k) AS BIGINT) AS components, round(sum(k) / sum(n), 6) AS ratio, CAST(min(k) AS INTEGER) AS least, CAST(max(k) AS INTEGER) AS most, quantile_cont(k, 0.5) AS median FROM k""")
def mixture_storage(spark, d):
    return m.storage(fitted(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(MIX + """, dens AS (SELECT h.src, h.op, h.x, any_value(h.n) AS n, sum(weight * exp(-0.5::DOUBLE * (h.x - mean) * (h.x - mean) / var) / sqrt(2 * pi() * var)) AS p FROM h JOIN mix ON mix.src = h.src AND mix.op = h.op GROUP BY h.src, h.op, h.x)
SELECT src, op, round(sum(n * -ln(greatest(p, 1e-300))) / sum(n), 4) AS nll FROM dens GROUP BY ALL""")
def mixture_fit(spark, d):
    nll = m.average_nll(m.histogram(gap_hours(spark, d), "gap", *KEY), fitted(spark, d), *KEY)
    return nll.select(*KEY, F.round("nll", 4).alias("nll"))


@query(MIX + """, heavy AS (SELECT src, op, count(*) AS components, -sum(weight * ln(weight)) AS entropy FROM mix WHERE weight >= 0.05 GROUP BY ALL)
SELECT src, op, CAST(components AS INTEGER) AS components, round(entropy, 5) AS entropy FROM heavy WHERE components >= 2""")
def multimodal_edges(spark, d):
    return m.multimodal(fitted(spark, d)).select(*KEY, "components", F.round("entropy", 5).alias("entropy"))


def digamma_sql(x: str) -> str:
    y = f"({x} + {SHIFT})"
    series = f"ln{y} - 0.5::DOUBLE / {y}" + "".join(f" + ({-b / (2 * i)!r}::DOUBLE) / {y} ** {2 * i}" for i, b in enumerate(BERNOULLI, 1))
    return "(" + series + "".join(f" - 1 / ({x} + {i})" for i in range(SHIFT)) + ")"


def variational_sql(rounds: int, components: int) -> str:
    out = f""", pr AS MATERIALIZED (SELECT src, op, m, total, least({components}, floor(total)) AS active, greatest(v * total / greatest(total - 1, 1), 1e-6) AS v0 FROM st WHERE total >= 2),
cu AS (SELECT src, op, x, n, total, active, sum(n) OVER (PARTITION BY src, op ORDER BY x) AS upto FROM c JOIN pr USING (src, op)),
s_0 AS (SELECT e.src, e.op, e.k, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM (SELECT src, op, k FROM pr, range(0, {components}) r(k) WHERE k < active) e
  LEFT JOIN (SELECT src, op, k, sum(n) AS s0, sum(n * x) AS s1, sum(n * x * x) AS s2 FROM (SELECT *, least(floor(active * (upto - n / 2) / total + 1e-9), active - 1) AS k FROM cu) GROUP BY ALL) z ON z.src = e.src AND z.op = e.op AND z.k = e.k)"""
    for i in range(rounds + 1):
        out += f""", a_{i} AS (SELECT *, s0 + 2.220446049250313e-15 AS nk FROM s_{i}),
b_{i} AS (SELECT a.*, 1 / active AS prior, v0, s1 / nk AS xk, greatest(s2 / nk - (s1 / nk) * (s1 / nk), 0) + 1e-6 AS sk, 1 + nk AS alpha, 1 / active + coalesce(sum(nk) OVER (PARTITION BY a.src, a.op ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS beta FROM a_{i} a JOIN pr USING (src, op)),
d_{i} AS (SELECT *, nk * xk / alpha AS mean, greatest((v0 + nk * (sk + xk * xk / alpha)) / alpha, 1e-6) AS var, {digamma_sql("alpha")} - {digamma_sql("(alpha + beta)")} AS own, {digamma_sql("beta")} - {digamma_sql("(alpha + beta)")} AS rest FROM b_{i}),
m_{i} AS MATERIALIZED (SELECT *, own + coalesce(sum(rest) OVER w, 0) - 0.5::DOUBLE * ln(2 * pi() * var) - 0.5::DOUBLE * ln(alpha) + 0.5::DOUBLE * (ln(2) + {digamma_sql("(alpha / 2)")} - 1 / alpha) AS base, alpha / (alpha + beta) * exp(coalesce(sum(ln(beta / (alpha + beta))) OVER w, 0)) AS weight
  FROM d_{i} WINDOW w AS (PARTITION BY src, op ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
        if i < rounds:
            out += f""", l_{i} AS (SELECT c.src, c.op, c.x, c.n, k, base - (c.x - mean) * (c.x - mean) / (2 * var) AS p FROM c JOIN m_{i} USING (src, op)),
t_{i} AS (SELECT *, max(p) OVER (PARTITION BY src, op, x) AS top FROM l_{i}),
r_{i} AS (SELECT src, op, k, x, n * exp(p - top) / sum(exp(p - top)) OVER (PARTITION BY src, op, x) AS r FROM t_{i}),
s_{i + 1} AS MATERIALIZED (SELECT src, op, k, sum(r) AS s0, sum(r * x) AS s1, sum(r * x * x) AS s2 FROM r_{i} GROUP BY ALL)"""
    return out


@query(WITH + HIST + stats_sql() + variational_sql(ROUNDS, COMPONENTS) + f" SELECT src, op, total AS n, CAST(k AS INTEGER) AS component, round(mean + m, 4) AS mean, round(var, 4) AS var, round(weight / sum(weight) OVER (PARTITION BY src, op), 5) AS weight FROM m_{ROUNDS} JOIN pr USING (src, op)")
def variational_mixtures(spark, d):
    return listed(m.variational(m.histogram(gap_hours(spark, d), "gap", *KEY), COMPONENTS, *KEY, rounds=ROUNDS, tolerance=0.0), "n")


@query(WITH + HIST + stats_sql() + variational_sql(ROUNDS, COMPONENTS) + f""", w AS (SELECT src, op, k, mean + m AS mean, var, weight / sum(weight) OVER (PARTITION BY src, op) AS weight FROM m_{ROUNDS} JOIN pr USING (src, op)),
u AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY src, op ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w), kept AS (SELECT * FROM u WHERE before < 0.9)
SELECT src, op, CAST(count(*) AS INTEGER) AS components, round(arg_max(mean, weight), 4) AS heaviest_mean, round(max(weight) / sum(weight), 5) AS heaviest_weight FROM kept GROUP BY ALL""")
def truncated_mixtures(spark, d):
    found = m.variational(m.histogram(gap_hours(spark, d), "gap", *KEY), COMPONENTS, *KEY, rounds=ROUNDS, tolerance=0.0)
    kept = found.select(*KEY, m.truncated("mixture", 0.9).alias("kept"))
    return kept.select(*KEY, F.size("kept").alias("components"), F.round(F.col("kept")[0]["mean"], 4).alias("heaviest_mean"), F.round(F.col("kept")[0]["weight"], 5).alias("heaviest_weight"))


def grid_sql(points: int, padding: float, h: str = "h") -> str:
    """CTEs up to grid(src, op, g, x, n)."""
    return f""", ends AS (SELECT src, op, min(x) AS low, max(x) AS high FROM {h} GROUP BY ALL), steps AS (SELECT src, op, low - {padding} * (high - low) AS start, CASE WHEN high > low THEN (high - low) * {1 + 2 * padding} / {points - 1} ELSE 1.0 END AS step FROM ends),
placed AS (SELECT src, op, n, start, step, (x - start) / step AS p, least(floor((x - start) / step), {points - 2}) AS g FROM {h} JOIN steps USING (src, op)),
grid AS MATERIALIZED (SELECT src, op, CAST(g AS INTEGER) AS g, any_value(start) + g * any_value(step) AS x, sum(n) AS n FROM (SELECT src, op, start, step, g, n * (1 - (p - g)) AS n FROM placed UNION ALL SELECT src, op, start, step, g + 1, n * (p - g) FROM placed) GROUP BY src, op, g HAVING sum(n) > 0)"""


@query(WITH + HIST + grid_sql(50, 0.1) + " SELECT src, op, g, round(x, 5) AS x, round(n, 5) AS n FROM grid WHERE n > 1e-6")
def gridded_gaps(spark, d):
    return m.gridded(m.histogram(gap_hours(spark, d), "gap", *KEY), 50, 0.1, *KEY).where("n > 1e-6").select(*KEY, "g", F.round("x", 5).alias("x"), F.round("n", 5).alias("n"))


@query(WITH + HIST + stats_sql() + grid_sql(32, 0.0) + """, q AS (SELECT src, op, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM g WHERE x IS NOT NULL GROUP BY ALL),
own AS (SELECT src, op, total, v, sqrt(v) AS std, least(sqrt(v), iqr / 1.34) AS sigma FROM st JOIN q USING (src, op)),
pairs AS (SELECT a.src, a.op, sum(a.n * b.n * (((a.x - b.x) / (sigma * sqrt(2))) ** 4 - 6 * ((a.x - b.x) / (sigma * sqrt(2))) ** 2 + 3) * exp(-0.5::DOUBLE * ((a.x - b.x) / (sigma * sqrt(2))) ** 2)) AS s FROM grid a JOIN grid b ON b.src = a.src AND b.op = a.op JOIN own o ON o.src = a.src AND o.op = a.op WHERE sigma > 0 GROUP BY ALL),
rough AS (SELECT o.*, s / (sqrt(2 * pi()) * (sigma * sqrt(2)) ** 5 * total * total) + 0.01::DOUBLE * v AS r FROM own o LEFT JOIN pairs USING (src, op))
SELECT src, op, round(CASE WHEN sigma > 0 AND r > 0 THEN 1.06::DOUBLE * sigma * total ** (-0.2::DOUBLE) / r ** 0.2::DOUBLE WHEN std > 0 THEN 1.06::DOUBLE * std * total ** (-0.2::DOUBLE) ELSE 1.0 END, 4) AS h FROM rough""")
def gap_bandwidths(spark, d):
    return m.bandwidth(m.histogram(gap_hours(spark, d), "gap", *KEY), *KEY, points=32).select(*KEY, F.round("h", 4).alias("h"))


SPLIT_NS = (a.EPOCH_DAY + 18) * a.DAY


def points_sql(points: int) -> str:
    import numpy as np

    nodes, weights = np.polynomial.hermite.hermgauss(points)
    rows = ", ".join(f"({float(z)!r}::DOUBLE, {float(w / weights.sum())!r}::DOUBLE)" for z, w in zip(nodes, weights, strict=True))
    return f"SELECT src, op, mean + sqrt(2 * var) * z AS x, n * weight * w AS n FROM mix, (VALUES {rows}) gh(z, w)"


@query(WITH + HOURS + f""", h AS MATERIALIZED (SELECT src, op, x, CAST(count(*) AS DOUBLE) AS n FROM g WHERE x IS NOT NULL AND t <= {SPLIT_NS} GROUP BY ALL), fresh AS MATERIALIZED (SELECT src, op, x, CAST(count(*) AS DOUBLE) AS n FROM g WHERE x IS NOT NULL AND t > {SPLIT_NS} GROUP BY ALL)""" + stats_sql() + mixture_sql()
+ f""", joined AS MATERIALIZED (SELECT src, op, x, sum(n) AS n FROM (SELECT * FROM fresh UNION ALL SELECT p.* FROM ({points_sql(5)}) p WHERE (p.src, p.op) IN (SELECT (src, op) FROM fresh)) GROUP BY ALL)""" + stats_sql("joined", "u") + mixture_sql("u")
+ f" SELECT src, op, round(n, 6) AS n, {SHOWN} FROM (SELECT * FROM mixu UNION ALL SELECT * FROM mix WHERE (src, op) NOT IN (SELECT (src, op) FROM fresh))")
def updated_mixtures(spark, d):
    rows = gap_hours(spark, d)
    fit = {"most": MOST, "cluster_rounds": CLUSTER_ROUNDS, "rounds": ROUNDS, "tolerance": 0.0}
    old = m.mixtures(rows.where(F.col("t") <= SPLIT_NS), "gap", *KEY, **fit)
    return listed(m.updated(old.select(*KEY, "n", "mixture"), rows.where(F.col("t") > SPLIT_NS), "gap", *KEY, points=5, **fit).withColumn("n", F.round("n", 6)), "n")

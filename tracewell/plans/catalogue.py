"""Named queries over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text, times
from tracewell.operators import features, graph, labels, queues as q, ranking, reduction, scoring, summaries, windows
from tracewell.sources import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with SQL if there is any."""

    def put(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised windows, fused edges, the highest loss of each node."""
    cut = windows.quantised_windows(a.prov(spark, sf_dir), block=8, size_ns=2 * a.HOUR)
    rows = scoring.node_losses(windows.fuse_runs(cut, "day", "tw").withColumn("loss", F.col("value")))
    return scoring.reduce_losses(rows, "node").orderBy(F.desc("score"), "node").limit(100)


WITH = "WITH RECURSIVE "
DAY27 = (a.EPOCH_DAY + 26) * a.DAY

# scans, projections, simple aggregates


@query(WITH + a.PROV + f" SELECT event_uuid, t, src, dst, op FROM prov WHERE t > {DAY27} AND t < {DAY27 + a.DAY}")
def day_scan_open(spark, d):
    return a.prov(spark, d).where((F.col("t") > DAY27) & (F.col("t") < DAY27 + a.DAY)).select("event_uuid", "t", "src", "dst", "op")


@query(WITH + a.PROV + ",\n" + a.ATTACKS + " SELECT attack_id, event_uuid, src, dst, op, t FROM prov JOIN attacks ON t BETWEEN start_ns AND end_ns")
def attack_scan_closed(spark, d):
    return labels.attack_events(a.prov(spark, d), a.attacks(spark)).select("attack_id", "event_uuid", "src", "dst", "op", "t")


@query(WITH + a.PROV + ",\n" + a.ATTACKS + " SELECT event_uuid, src, dst, op, t FROM prov WHERE src IN (SELECT node_id FROM attack_nodes) AND dst IN (SELECT node_id FROM attack_nodes)")
def induced_scan(spark, d):
    return labels.induced(a.prov(spark, d), a.attack_nodes(spark)).select("event_uuid", "src", "dst", "op", "t")


@query(WITH + a.PROV + ",\n" + a.NODES + " SELECT node_id, node_type, label, concat(node_type, ' ', label) AS msg, sha256(concat(node_type, ' ', label)) AS msg_hash FROM nodes")
def node_labels(spark, d):
    msg = text.label(F.col("node_type"), F.col("label"))
    return a.nodes(a.prov(spark, d)).withColumn("msg", msg).withColumn("msg_hash", F.sha2(msg, 256))


@query(WITH + a.PROV + " SELECT event_uuid, strftime(timezone('US/Eastern', timezone('UTC', make_timestamp(t // 1000))), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(t % 1000000000 AS VARCHAR), 9, '0') AS name FROM prov")
def us_eastern_names(spark, d):
    return a.prov(spark, d).select("event_uuid", times.eastern(F.col("t")).alias("name"))


@query(WITH + a.PROV + " SELECT op, count(*) AS n FROM prov WHERE op IN ('READ', 'WRITE', 'CONNECT') GROUP BY op")
def included_operations(spark, d):
    return a.prov(spark, d).where(F.col("op").isin("READ", "WRITE", "CONNECT")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + a.PROV + ",\n" + a.NODES + " SELECT node_id, node_type FROM nodes WHERE contains(label, '/f/1') OR contains(label, '.7')")
def benign_keywords(spark, d):
    return a.nodes(a.prov(spark, d)).where(F.col("label").contains("/f/1") | F.col("label").contains(".7")).select("node_id", "node_type")


@query(WITH + a.PROV + " SELECT count(*) AS pairs FROM (SELECT DISTINCT src, dst FROM prov)")
def distinct_edges(spark, d):
    return reduction.multiplicity(a.prov(spark, d)).agg(F.count(F.lit(1)).alias("pairs"))


@query("WITH " + a.TRADE + " SELECT src, dst, count(*) AS n FROM trade GROUP BY src, dst HAVING count(*) > 10")
def edge_multiplicity_gt10(spark, d):
    return reduction.multiplicity(a.trade(spark, d)).where("n > 10")


@query("WITH " + a.TRADE + """, m AS (SELECT count(*) AS n FROM trade GROUP BY src, dst HAVING count(*) > 10)
SELECT CAST(count(*) AS DOUBLE) AS pairs, round(coalesce(avg(n), 0), 6) AS mean, CAST(coalesce(min(n), 0) AS DOUBLE) AS min, CAST(coalesce(max(n), 0) AS DOUBLE) AS max, round(coalesce(stddev_pop(n), 0), 6) AS std,
round(coalesce(quantile_cont(n, 0.25), 0), 6) AS p25, round(coalesce(quantile_cont(n, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(n, 0.75), 0), 6) AS p75, round(coalesce(quantile_cont(n, 0.9), 0), 6) AS p90, round(coalesce(quantile_cont(n, 0.95), 0), 6) AS p95, round(coalesce(quantile_cont(n, 0.99), 0), 6) AS p99 FROM m""")
def edge_multiplicity_stats(spark, d):
    return reduction.multiplicity_stats(a.trade(spark, d))


# windows, batches, fusion

BLOCKS = a.PROV + """,
placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY day ORDER BY t, event_uuid) - 1) // 8 AS INTEGER) AS block FROM prov),
blocks AS (SELECT day, block, min(t) AS first_t, max(t) AS last_t, block = max(block) OVER (PARTITION BY day) AS is_last FROM placed GROUP BY day, block),
fold(day, block, tw, start_ns, last_t) AS (SELECT day, block, 0, first_t, last_t FROM blocks WHERE block = 0
  UNION ALL SELECT b.day, b.block, CASE WHEN f.last_t > f.start_ns + 7200000000000 THEN f.tw + 1 ELSE f.tw END, CASE WHEN f.last_t > f.start_ns + 7200000000000 THEN f.last_t ELSE f.start_ns END, b.last_t
  FROM fold f JOIN blocks b ON b.day = f.day AND b.block = f.block + 1),
cut AS (SELECT p.*, f.tw, f.start_ns, max(f.last_t) OVER (PARTITION BY p.day, f.tw) AS end_ns FROM placed p JOIN fold f USING (day, block))"""


def cut(spark, d):
    return windows.quantised_windows(a.prov(spark, d), block=8, size_ns=2 * a.HOUR)


@query(WITH + BLOCKS + " SELECT day, tw, start_ns, end_ns, count(*) AS n FROM cut GROUP BY ALL")
def windows_quantised(spark, d):
    return cut(spark, d).groupBy("day", "tw", "start_ns", "end_ns").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + BLOCKS + " SELECT event_uuid, day, tw FROM cut")
def window_membership(spark, d):
    return cut(spark, d).select("event_uuid", "day", "tw")


@query(WITH + a.PROV + " SELECT t // 900000000000 AS tw, count(*) AS n FROM prov GROUP BY 1")
def windows_fixed(spark, d):
    return windows.fixed_windows(a.prov(spark, d), 900_000_000_000).groupBy("tw").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + BLOCKS + " SELECT day, tw, src, dst, arg_min(op, (t, event_uuid)) AS op, count(*) AS n FROM cut GROUP BY ALL")
def window_pair_graphs(spark, d):
    return windows.pair_graphs(cut(spark, d), "day", "tw")


@query(WITH + BLOCKS + ", g AS (SELECT day, src, dst, arg_min(op, (t, event_uuid)) AS op, count(*) AS n FROM cut GROUP BY ALL) SELECT day, tw, src, dst, op, n FROM g JOIN (SELECT DISTINCT day, tw FROM cut) USING (day)")
def day_pair_graphs(spark, d):
    return windows.pair_graphs(cut(spark, d), "day", "tw", whole_day="day")


FUSED = a.TRADE + """, lagged AS (SELECT *, lag(op) OVER (PARTITION BY src, dst ORDER BY t, event_uuid) AS before FROM trade),
fused AS (SELECT event_uuid, src, dst, op, t FROM lagged WHERE before IS NULL OR before <> op)"""


@query("WITH " + FUSED + " SELECT * FROM fused")
def fused_edges(spark, d):
    return windows.fuse_runs(a.trade(spark, d)).select("event_uuid", "src", "dst", "op", "t")


@query(WITH + a.PROV + " SELECT event_uuid, day, CAST((row_number() OVER (PARTITION BY day ORDER BY t, event_uuid) - 1) // 100 AS INTEGER) AS batch FROM prov")
def edge_batches(spark, d):
    return windows.row_batches(a.prov(spark, d), 100, "day").select("event_uuid", "day", "batch")


@query(WITH + a.PROV + """, s AS (SELECT *, min(t) OVER (PARTITION BY day) // 600000000000 * 600000000000 AS st FROM prov), b AS (SELECT *, (t - st) // 600000000000 AS batch FROM s)
SELECT event_uuid, day, batch FROM b WHERE t < st + batch * 600000000000 + 300000000000""")
def minute_batches(spark, d):
    return windows.minute_batches(a.prov(spark, d), 600_000_000_000, 300_000_000_000, "day").select("event_uuid", "day", "batch")


@query(WITH + a.PROV + """, o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY t, event_uuid) - 1 AS pos FROM prov),
p AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY day, src, dst ORDER BY pos), -1) AS prev FROM o),
fold(day, pos, start, batch) AS (SELECT day, pos, CAST(0 AS BIGINT), 0 FROM p WHERE pos = 0
 UNION ALL SELECT p.day, p.pos, CASE WHEN p.prev >= f.start THEN p.pos ELSE f.start END, CASE WHEN p.prev >= f.start THEN f.batch + 1 ELSE f.batch END FROM fold f JOIN p ON p.day = f.day AND p.pos = f.pos + 1)
SELECT event_uuid, day, batch FROM fold JOIN p USING (day, pos)""")
def distinct_pair_batches(spark, d):
    return windows.pair_batches(a.prov(spark, d), "day").select("event_uuid", "day", "batch")


@query(WITH + a.PROV + " SELECT day, node, CAST(row_number() OVER (PARTITION BY day ORDER BY node) - 1 AS INTEGER) AS local FROM (SELECT day, src AS node FROM prov UNION SELECT day, dst FROM prov)")
def local_reindex(spark, d):
    return windows.local_ids(a.prov(spark, d), "day")


@query(WITH + a.LOSSES + ", g AS (SELECT tw, CAST((row_number() OVER (ORDER BY tw) - 1) // 4 AS INTEGER) AS graph FROM (SELECT DISTINCT tw FROM losses)) SELECT graph, count(*) AS n, count(DISTINCT tw) AS windows FROM losses JOIN g USING (tw) GROUP BY graph")
def graph_batches(spark, d):
    return windows.window_groups(a.losses(spark, d), 4).groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tw").alias("windows"))


@query("WITH " + a.PROV + """, ends AS (SELECT day, min(t) AS low, max(t) AS high FROM prov GROUP BY day) SELECT DISTINCT day, unnest(list_append(range(low, high + 1, 3600000000000), high)) AS t FROM ends""")
def interval_stamps(spark, d):
    ends = a.prov(spark, d).groupBy("day").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    return windows.interval_stamps(ends, "low", "high", a.HOUR, "day")


RECENCY = a.PROV + ", n AS (SELECT src, t // 86400000000000 AS tw, count(*) AS n FROM prov GROUP BY 1, 2)"


@query(WITH + RECENCY + """ SELECT src, tw, n, coalesce(n - lag(n) OVER w, 0) AS change, round(avg(n) OVER (PARTITION BY src ORDER BY tw ROWS UNBOUNDED PRECEDING), 6) AS mean_n,
coalesce(round(n / 86400.0 - lag(n / 86400.0) OVER w, 9), 0) AS density_change, round(avg(n / 86400.0) OVER (PARTITION BY src ORDER BY tw ROWS UNBOUNDED PRECEDING), 9) AS mean_density FROM n WINDOW w AS (PARTITION BY src ORDER BY tw)""")
def recency_features(spark, d):
    r = windows.recency(a.prov(spark, d), a.DAY, "src")
    return r.select("src", "tw", "n", F.coalesce("change", F.lit(0)).alias("change"), F.round("mean_n", 6).alias("mean_n"), F.coalesce(F.round("density_change", 9), F.lit(0.0)).alias("density_change"), F.round("mean_density", 9).alias("mean_density"))


@query("WITH " + a.TRADE + " SELECT event_uuid, CAST((row_number() OVER (PARTITION BY src, dst ORDER BY t, event_uuid) - 1) // 5 AS INTEGER) AS chunk FROM trade")
def key_chunks(spark, d):
    return windows.chunks(a.trade(spark, d), 5, "src", "dst").select("event_uuid", "chunk")


# reduction

KEYED = "WITH " + a.TRADE + ", e AS (SELECT *, t // 7776000000000000 AS tw FROM trade)"
COLLAPSED = KEYED + ", c AS (SELECT tw, src, dst, op, arg_min(event_uuid, (t, event_uuid)) AS event_uuid, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM e GROUP BY tw, src, dst, op)"


def quarters(spark, d):
    return windows.fixed_windows(a.trade(spark, d), 7_776_000_000_000_000)


@query(COLLAPSED + " SELECT * FROM c")
def reduce_all(spark, d):
    return reduction.collapse_all(quarters(spark, d), "tw")


ELIGIBLE = KEYED + """, f AS (SELECT src, dst, op FROM e GROUP BY ALL HAVING count(*) >= 10),
r AS (SELECT e.*, f.src IS NOT NULL AS hit, row_number() OVER (PARTITION BY tw, e.src, e.dst, e.op ORDER BY t, event_uuid) AS rank, count(*) OVER (PARTITION BY tw, e.src, e.dst, e.op) AS m FROM e LEFT JOIN f ON e.src = f.src AND e.dst = f.dst AND e.op = f.op)"""


@query(ELIGIBLE + " SELECT tw, event_uuid, src, dst, op, hit, CASE WHEN hit THEN m ELSE 1 END AS n FROM r WHERE NOT hit OR rank = 1")
def reduce_eligible(spark, d):
    e = quarters(spark, d)
    return reduction.collapse_eligible(e, reduction.counts(e).where("frequent"), "tw").select("tw", "event_uuid", "src", "dst", "op", "hit", "n")


@query(COLLAPSED + """, w AS (SELECT *, min(first_t) OVER (PARTITION BY tw) AS low, max(last_t) OVER (PARTITION BY tw) AS high FROM c)
SELECT tw, src, dst, op, round((first_t - low) / CASE WHEN high - low < 1e-6 THEN 1 ELSE CAST(high - low AS DOUBLE) END, 6) AS f_first, round((last_t - low) / CASE WHEN high - low < 1e-6 THEN 1 ELSE CAST(high - low AS DOUBLE) END, 6) AS f_last, round(ln(1 + n) / 10, 6) AS f_count FROM w""")
def temporal_features(spark, d):
    f = reduction.temporal_features(reduction.collapse_all(quarters(spark, d), "tw"), "tw")
    return f.select("tw", "src", "dst", "op", *(F.round(c, 6).alias(c) for c in ("f_first", "f_last", "f_count")))


STATS = COLLAPSED + ", s AS (SELECT tw, original, reduced, original - reduced AS removed, round(100.0 * CAST(original - reduced AS DOUBLE) / original, 6) AS ratio FROM (SELECT tw, count(*) AS original FROM e GROUP BY tw) JOIN (SELECT tw, count(*) AS reduced FROM c GROUP BY tw) USING (tw))"


@query(STATS + " SELECT * FROM s")
def reduction_stats(spark, d):
    e = quarters(spark, d)
    return reduction.reduction_stats(e, reduction.collapse_all(e, "tw"), "tw")


@query(STATS + " SELECT CASE WHEN tw % 2 = 0 THEN 'even' ELSE 'odd' END AS split, CAST(sum(original) AS BIGINT) AS original, CAST(sum(reduced) AS BIGINT) AS reduced, CAST(sum(removed) AS BIGINT) AS removed, round(avg(ratio), 6) AS mean_ratio FROM s GROUP BY 1")
def reduction_totals(spark, d):
    e = quarters(spark, d)
    s = reduction.reduction_stats(e, reduction.collapse_all(e, "tw"), "tw")
    return reduction.split_totals(s.withColumn("split", F.when(F.col("tw") % 2 == 0, "even").otherwise("odd")))


@query("WITH " + a.TRADE + ", f AS (SELECT *, t - min(t) OVER (PARTITION BY dst) AS d FROM trade) SELECT src, dst, op, min(d) AS min_d, max(d) AS max_d, count(*) AS n FROM f GROUP BY src, dst, op")
def min_time_diff_merge(spark, d):
    return reduction.min_time_diffs(a.trade(spark, d))


@query("WITH " + a.TRADE + " SELECT src, op, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM trade GROUP BY src, op")
def merged_edge_spans(spark, d):
    e = a.trade(spark, d)
    merged = reduction.merge_sets(reduction.merged_edges(e.where("event_uuid % 2 = 0"), "src", "op"), reduction.merged_edges(e.where("event_uuid % 2 = 1"), "src", "op"), "src", "op")
    return merged.select("src", "op", F.size("times").cast("long").alias("n"), F.get("times", F.lit(0)).alias("first_t"), F.element_at("times", -1).alias("last_t"))


GAPS = WITH + a.PROV + ", g AS (SELECT src, op, (t - lag(t) OVER (PARTITION BY src, op ORDER BY t, event_uuid)) / 1e9 AS gap FROM prov), gg AS (SELECT * FROM g WHERE gap IS NOT NULL)"


def gap_seconds(spark, d):
    return windows.gaps(a.prov(spark, d), "src", "op").select("src", "op", (F.col("gap") / 1e9).alias("gap"))


@query(GAPS + """, m AS (SELECT *, avg(gap) OVER (PARTITION BY src, op) AS m FROM gg)
SELECT src, op, count(*) AS n, round(avg(gap), 3) AS mean, round(stddev_pop(gap), 3) AS std, round(coalesce(avg((gap - m) ** 3) / nullif(stddev_pop(gap) ** 3, 0), 0), 5) AS skew, round(coalesce(avg((gap - m) ** 4) / nullif(stddev_pop(gap) ** 4, 0) - 3, 0), 5) AS kurt,
round(quantile_cont(gap, 0.25), 3) AS q25, round(quantile_cont(gap, 0.5), 3) AS q50, round(quantile_cont(gap, 0.75), 3) AS q75, round(max(gap) - min(gap), 3) AS range FROM m GROUP BY src, op""")
def interarrival_moments(spark, d):
    m = reduction.moments(gap_seconds(spark, d), "gap", "src", "op")
    m = m.withColumn("skew", F.when(F.col("std") == 0, 0.0).otherwise(F.col("skew"))).withColumn("kurt", F.when(F.col("std") == 0, 0.0).otherwise(F.col("kurt")))
    return m.select("src", "op", "n", *(F.round(c, 3).alias(c) for c in ("mean", "std")), *(F.round(c, 5).alias(c) for c in ("skew", "kurt")), *(F.round(c, 3).alias(c) for c in ("q25", "q50", "q75", "range")))


@query(GAPS + """, s AS (SELECT *, (gap - min(gap) OVER w) / coalesce(nullif(max(gap) OVER w - min(gap) OVER w, 0), 1) AS x FROM gg WINDOW w AS (PARTITION BY src, op))
SELECT src, op, """ + ", ".join(f"round(avg({f}(2 * 3.141592653589793::DOUBLE * {k} * x)), 6) AS {f}{k}" for k in (1, 2, 3) for f in ("cos", "sin")) + " FROM s GROUP BY src, op")
def fourier_features(spark, d):
    f = reduction.fourier(gap_seconds(spark, d), "gap", 3, "src", "op")
    return f.select("src", "op", *(F.round(c, 6).alias(c) for c in f.columns[2:]))


NODES5 = [-2.0, -1.0, 0.0, 1.0, 2.0]


@query(GAPS + """, p AS (SELECT src, op, gap AS x, avg(gap) OVER w AS m, stddev_samp(gap) OVER w AS s, count(*) OVER w AS n FROM gg WINDOW w AS (PARTITION BY src, op)), h AS (SELECT *, n ** (-0.2::DOUBLE) * s AS h FROM p WHERE n > 1 AND s > 0)
SELECT src, op, """ + ", ".join(f"round(avg(exp(-0.5::DOUBLE * (((m + ({v}::DOUBLE) * s - x) / h) ** 2)) / (h * 2.5066282746310002::DOUBLE)), 9) AS kde{i}" for i, v in enumerate(NODES5)) + " FROM h GROUP BY src, op")
def kde_nodes(spark, d):
    k = reduction.kde_at(gap_seconds(spark, d), "gap", NODES5, "src", "op")
    return k.select("src", "op", *(F.round(f"kde{i}", 9).alias(f"kde{i}") for i in range(5)))


@query(WITH + a.PROV + """, b AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, max(abs(value)) OVER w AS top FROM prov WINDOW w AS (PARTITION BY src))
SELECT event_uuid, round((value - lo) / coalesce(nullif(hi - lo, 0), 1), 5) AS min_max, round((value - m) / coalesce(nullif(s, 0), 1), 5) AS standard, round(value / coalesce(nullif(top, 0), 1), 5) AS max_abs FROM b""")
def scaled_values(spark, d):
    return reduction.scaled(a.prov(spark, d), "value", "src").select("event_uuid", *(F.round(c, 5).alias(c) for c in ("min_max", "standard", "max_abs")))


@query(WITH + a.PROV + " SELECT event_uuid, src, t FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('7|' || event_uuid), event_uuid) AS r FROM prov) WHERE r <= 10")
def long_series_sample(spark, d):
    return reduction.sample_long(a.prov(spark, d), 10, 7, "src").select("event_uuid", "src", "t")


# labels and scores


def _mal(selection: str) -> None:
    test = {"src_node": "s.node_id IS NOT NULL", "dst_node": "d.node_id IS NOT NULL", "both_nodes": "s.node_id IS NOT NULL AND d.node_id IS NOT NULL", "either_node": "s.node_id IS NOT NULL OR d.node_id IS NOT NULL"}[selection]
    f = lambda spark, d: labels.malicious_edges(a.prov(spark, d), a.attacks(spark), a.attack_nodes(spark), selection)
    f.__name__ = f"malicious_edges_{selection}"
    query(WITH + a.PROV + ",\n" + a.ATTACKS + f""" SELECT DISTINCT e.attack_id, src, dst, t, op FROM (SELECT * FROM prov JOIN attacks ON t BETWEEN start_ns AND end_ns) e
 LEFT JOIN attack_nodes s ON s.attack_id = e.attack_id AND s.node_id = src LEFT JOIN attack_nodes d ON d.attack_id = e.attack_id AND d.node_id = dst WHERE {test}""")(f)


for _s in labels.SELECTIONS:
    _mal(_s)


@query(WITH + a.PROV + ",\n" + a.ATTACKS + """, w AS (SELECT t // 21600000000000 AS tw, min(t) AS start_ns, max(t) AS end_ns FROM prov GROUP BY 1),
ends AS (SELECT e.t, n.node_id FROM (SELECT attack_id, t, unnest([src, dst]) AS node_id FROM prov JOIN attacks ON t BETWEEN start_ns AND end_ns) e JOIN attack_nodes n ON n.attack_id = e.attack_id AND n.node_id = e.node_id)
SELECT tw, node_id, count(*) AS n FROM ends JOIN w ON t > start_ns AND t < end_ns GROUP BY tw, node_id""")
def malicious_nodes_per_window(spark, d):
    e = a.prov(spark, d)
    w = windows.fixed_windows(e, 6 * a.HOUR).groupBy("tw").agg(F.min("t").alias("start_ns"), F.max("t").alias("end_ns"))
    return labels.malicious_per_window(e, w, a.attacks(spark), a.attack_nodes(spark))


@query("WITH " + a.ATTACKS + " SELECT node_id, string_agg(CAST(attack_id AS VARCHAR), ',' ORDER BY attack_id) AS attacks FROM attack_nodes GROUP BY node_id")
def node_attacks(spark, d):
    m = labels.memberships(a.attack_nodes(spark))
    return m.select("node_id", F.array_join(F.transform("attacks", lambda x: x.cast("string")), ",").alias("attacks"))


@query(WITH + a.LOSSES + ",\n" + a.ATTACKS + """, bad AS (SELECT DISTINCT src, dst, t, op FROM (SELECT * FROM prov JOIN attacks ON t BETWEEN start_ns AND end_ns) e WHERE EXISTS (SELECT 1 FROM attack_nodes n WHERE n.attack_id = e.attack_id AND n.node_id IN (e.src, e.dst)))
SELECT event_uuid, CASE WHEN bad.t IS NULL THEN 0 ELSE 1 END AS y FROM losses l LEFT JOIN bad ON l.src = bad.src AND l.dst = bad.dst AND l.t = bad.t AND l.op = bad.op""")
def edge_truth(spark, d):
    bad = labels.malicious_edges(a.prov(spark, d), a.attacks(spark), a.attack_nodes(spark), "either_node")
    return labels.mark(a.losses(spark, d), bad, ["src", "dst", "t", "op"]).select("event_uuid", "y")


@query(WITH + a.LOSSES + ", f AS (SELECT src, dst, op FROM losses WHERE split <> 'test' GROUP BY ALL HAVING count(*) >= 2) SELECT tw, count(*) AS edges, CAST(sum(CASE WHEN f.src IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS eligible, round(avg(CASE WHEN f.src IS NULL THEN 0 ELSE 1 END), 6) AS share FROM losses l LEFT JOIN f ON l.src = f.src AND l.dst = f.dst AND l.op = f.op GROUP BY tw")
def eligible_share(spark, d):
    e = a.losses(spark, d)
    return labels.eligible_share(e, reduction.counts(e.where("split != 'test'"), 2).where("frequent"), "tw")


@query(WITH + a.LOSSES + " SELECT round(max(loss), 6) AS max_val_loss, round(avg(loss), 6) AS mean_val_loss, round(quantile_cont(loss, 0.9), 6) AS p90_val_loss FROM losses WHERE split = 'val'")
def loss_thresholds(spark, d):
    return scoring.thresholds(a.losses(spark, d).where("split = 'val'"))


ENDS = WITH + a.LOSSES + ", ends AS (SELECT unnest([src, dst]) AS node, loss, tw FROM losses WHERE split = 'test')"


def test_ends(spark, d):
    return scoring.node_losses(a.losses(spark, d).where("split = 'test'"))


@query(ENDS + " SELECT node, max(loss) AS score, round(avg(loss), 6) AS mean FROM ends GROUP BY node")
def node_scores(spark, d):
    e = test_ends(spark, d)
    return scoring.reduce_losses(e, "node").join(scoring.reduce_losses(e, "node", how="mean").select("node", F.round("score", 6).alias("mean")), "node")


@query(ENDS + " SELECT node, tw, max(loss) AS score FROM ends GROUP BY node, tw")
def node_window_scores(spark, d):
    return scoring.reduce_losses(test_ends(spark, d), "node", "tw")


@query(WITH + a.LOSSES + " SELECT tw, max(loss) AS score FROM losses WHERE split = 'test' GROUP BY tw")
def window_scores(spark, d):
    return scoring.reduce_losses(a.losses(spark, d).where("split = 'test'"), "tw")


@query(ENDS + " SELECT node, CASE WHEN max(loss) > 0 THEN arg_max(tw, (loss, -tw)) ELSE -1 END AS tw FROM ends GROUP BY node")
def max_loss_window(spark, d):
    return scoring.max_loss_window(test_ends(spark, d))


RESULTS = ENDS + ",\n" + a.ATTACKS + ", results AS (SELECT node, max(loss) AS score, CASE WHEN node IN (SELECT node_id FROM attack_nodes) THEN 1 ELSE 0 END AS y FROM ends GROUP BY node)"


def results(spark, d):
    return labels.mark(scoring.reduce_losses(test_ends(spark, d), "node"), a.attack_nodes(spark).withColumnRenamed("node_id", "node"), ["node"])


CONFUSION = """SELECT tp, fp, tn, fn, round(tp / (tp + fp + 1e-12), 5) AS precision, round(tp / (tp + fn + 1e-12), 5) AS recall, round(fp / (fp + tn + 1e-12), 7) AS fpr,
round(2 * (tp / (tp + fp + 1e-12)) * (tp / (tp + fn + 1e-12)) / (tp / (tp + fp + 1e-12) + tp / (tp + fn + 1e-12) + 1e-12), 5) AS fscore, round((tp + tn) / (tp + tn + fp + fn + 1e-12), 5) AS accuracy,
round((tp / (tp + fn + 1e-12) + tn / (tn + fp + 1e-12)) / 2, 5) AS balanced_acc, round((tp / (tp + fn + 1e-12)) / (fp / (fp + tn + 1e-12) + 1e-12), 5) AS lr_plus, round(tp * tn / (fp * fn + 1e-12), 5) AS dor,
round((tp * tn - fp * fn) / (sqrt(CAST((tp + fp) AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-12), 5) AS mcc FROM c"""


@query(RESULTS + ", c AS (SELECT count(*) FILTER (y = 1 AND score > 300) AS tp, count(*) FILTER (y = 0 AND score > 300) AS fp, count(*) FILTER (y = 0 AND score <= 300) AS tn, count(*) FILTER (y = 1 AND score <= 300) AS fn FROM results) " + CONFUSION)
def confusion_metrics(spark, d):
    return scoring.confusion(results(spark, d), F.col("y"), (F.col("score") > 300).cast("int"))


LABELLED = "WITH j AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def quality(spark, d):
    return a.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(a.table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").where("y IS NOT NULL")


@query(LABELLED + ", r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM j) SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r")
def roc_auc(spark, d):
    return scoring.roc_auc(quality(spark, d), "score", "y")


@query(LABELLED + ", g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM j GROUP BY score), u AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS m FROM g) SELECT round(sum(pos * tp / m) / sum(pos), 6) AS average_precision FROM u")
def average_precision(spark, d):
    return scoring.average_precision(quality(spark, d), "score", "y")


@query(RESULTS + " SELECT node, score, y, CASE WHEN score > 300 THEN 1 ELSE 0 END AS y_hat, CASE WHEN y = 1 AND score > 300 THEN 'TP' WHEN score > 300 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS category FROM results")
def node_classes(spark, d):
    return scoring.classified(results(spark, d).withColumn("y_hat", (F.col("score") > 300).cast("int")))


@query(WITH + a.LOSSES + """, t AS (SELECT *, avg(loss) OVER (PARTITION BY tw) + 1.5 * stddev_pop(loss) OVER (PARTITION BY tw) AS threshold FROM losses WHERE split = 'test'), hot AS (SELECT * FROM t WHERE loss > threshold)
SELECT tw, round(min(threshold), 6) AS threshold, count(*) FILTER (loss > threshold) AS n, round(coalesce(avg(loss) FILTER (loss > threshold), 0), 6) AS mean_loss, (SELECT count(DISTINCT node) FROM (SELECT unnest([src, dst]) AS node FROM hot WHERE hot.tw = t.tw)) AS nodes,
(SELECT count(*) FROM (SELECT DISTINCT src, dst, op FROM hot WHERE hot.tw = t.tw)) AS edges FROM t GROUP BY tw""")
def window_anomalies(spark, d):
    return scoring.window_anomalies(a.losses(spark, d).where("split = 'test'"))


@query(WITH + a.PROV + ", k AS (SELECT unnest(['READ', 'OPEN', 'WRITE', 'CONNECT', 'RECVFROM', 'CLONE']) AS op), n AS (SELECT op, count(*) AS n FROM prov GROUP BY op) SELECT op, round(CASE WHEN n IS NULL THEN 0 ELSE (SELECT count(*) FROM prov) / (6.0 * n) END, 6) AS weight FROM k LEFT JOIN n USING (op)")
def class_weights(spark, d):
    kinds = spark.createDataFrame([(x,) for x in ("READ", "OPEN", "WRITE", "CONNECT", "RECVFROM", "CLONE")], "op string")
    return scoring.class_weights(a.prov(spark, d), "op", kinds)


@query(RESULTS + " SELECT attack_id, CAST(coalesce(sum(CASE WHEN score > 300 THEN 1 WHEN score IS NULL THEN NULL ELSE 0 END), 0) AS BIGINT) AS tps, count(*) AS nodes FROM attack_nodes LEFT JOIN results ON node = node_id GROUP BY attack_id")
def detected_attacks(spark, d):
    return scoring.detected_attacks(results(spark, d).withColumn("y_hat", (F.col("score") > 300).cast("int")), a.attack_nodes(spark))


# rankings

RUN = RESULTS + """, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, node) AS rank FROM results),
first AS (SELECT rank, count(*) AS new FROM (SELECT attack_id, min(rank) AS rank FROM ranked JOIN attack_nodes ON node = node_id WHERE y = 1 GROUP BY attack_id) GROUP BY rank),
run AS (SELECT r.*, sum(y) OVER (ORDER BY r.rank) AS tp, r.rank - sum(y) OVER (ORDER BY r.rank) AS fp, sum(coalesce(new, 0)) OVER (ORDER BY r.rank) AS hit FROM ranked r LEFT JOIN first USING (rank)),
adp AS (SELECT precision, max(detected) AS detected FROM (SELECT CAST(tp AS DOUBLE) / rank AS precision, CAST(100.0 * hit / 3 AS DOUBLE) AS detected FROM run UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE) GROUP BY precision)"""


@query(RUN + " SELECT round(precision, 9) AS precision, round(detected, 6) AS detected FROM adp")
def adp_curve(spark, d):
    c = ranking.adp_curve(results(spark, d), a.attack_nodes(spark))
    return c.select(F.round("precision", 9).alias("precision"), F.round("detected", 6).alias("detected"))


@query(RUN + " SELECT round(sum(step) / 100, 6) AS area FROM (SELECT (precision - lag(precision) OVER (ORDER BY precision)) * (detected + lag(detected) OVER (ORDER BY precision)) / 2 AS step FROM adp)")
def adp_area(spark, d):
    return ranking.area(ranking.adp_curve(results(spark, d), a.attack_nodes(spark)), "precision", "detected")


@query(RUN + """, rc AS (SELECT precision, max(recall) AS recall FROM (SELECT CAST(tp AS DOUBLE) / rank AS precision, CAST(tp AS DOUBLE) / (SELECT sum(y) FROM results) AS recall FROM run UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE) GROUP BY precision)
SELECT round(sum(step) / 100, 6) AS area FROM (SELECT (precision - lag(precision) OVER (ORDER BY precision)) * (recall + lag(recall) OVER (ORDER BY precision)) / 2 AS step FROM rc)""")
def recall_precision_area(spark, d):
    return ranking.area(ranking.recall_curve(results(spark, d)), "precision", "recall")


@query(RUN + " SELECT attack_id, round((max(score) - (SELECT avg(score) FROM (SELECT score FROM ranked WHERE y = 0 ORDER BY rank LIMIT 10))) / (SELECT max(score) FROM results), 6) AS score FROM results JOIN attack_nodes ON node = node_id GROUP BY attack_id")
def discrimination(spark, d):
    return ranking.discrimination(results(spark, d), a.attack_nodes(spark))


@query(RUN + """, bad AS (SELECT row_number() OVER (ORDER BY rank) AS r, score AS bad FROM ranked WHERE y = 1 ORDER BY rank LIMIT 4), good AS (SELECT row_number() OVER (ORDER BY rank) AS r, score AS good FROM ranked WHERE y = 0 ORDER BY rank LIMIT 4),
dd AS (SELECT r, bad - good AS d FROM bad JOIN good USING (r)), reach AS (SELECT greatest(max(bad), max(good)) - least(min(bad), min(good)) AS x FROM bad JOIN good USING (r))
SELECT round(coalesce(sum(s), 0) / ((SELECT x FROM reach) * 4), 6) AS area FROM (SELECT (d + lag(d) OVER (ORDER BY r)) / 2 AS s FROM dd WHERE d > 0)""")
def discrimination_area(spark, d):
    return ranking.discrimination_area(results(spark, d), 4)


@query(RUN + " SELECT count(*) AS tps FROM run WHERE y = 1 AND fp = 0")
def zero_fp_prefix(spark, d):
    return ranking.zero_fp_prefix(results(spark, d))


@query(RUN + " SELECT count(*) FILTER (y = 0) AS fps, count(*) FILTER (y = 1) AS tps FROM run WHERE hit < 3")
def detected_until_all(spark, d):
    return ranking.until_all_detected(results(spark, d), a.attack_nodes(spark))


@query(RUN + """, e AS (SELECT min(score) AS lo, max(score) AS hi FROM results), th AS (SELECT CAST(k AS INTEGER) AS k, lo + k * (hi - lo) / 299 AS t FROM range(300) x(k), e), b AS (SELECT least(CAST(floor((score - lo) / ((hi - lo) / 299)) AS INTEGER), 299) AS kk, y FROM results, e),
m AS (SELECT k, t, (SELECT count(*) FROM b WHERE kk >= k AND y = 1) AS tp, (SELECT count(*) FROM b WHERE kk >= k AND y = 0) AS fp, (SELECT count(*) FROM b WHERE kk < k AND y = 1) AS fn, (SELECT count(*) FROM b WHERE kk < k AND y = 0) AS tn FROM th)
SELECT k, round(t, 6) AS threshold, round(tp / (tp + fn), 6) AS recall, round(tp * tn / (fp * fn + 1e-12), 3) AS dor FROM m""")
def dor_curve(spark, d):
    return ranking.dor_curve(results(spark, d))


@query(RUN + """, top AS (SELECT node, score FROM results ORDER BY score DESC, node LIMIT 40), s AS (SELECT *, row_number() OVER w AS i, count(*) OVER up AS n1, sum(score) OVER up AS s1, sum(score * score) OVER up AS q1, count(*) OVER down AS n2, sum(score) OVER down AS s2, sum(score * score) OVER down AS q2 FROM top
WINDOW w AS (ORDER BY score, node DESC), up AS (ORDER BY score, node DESC ROWS UNBOUNDED PRECEDING), down AS (ORDER BY score, node DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT arg_min(i, (round((q1 - s1 * s1 / n1) + (q2 - s2 * s2 / n2), 9), i)) AS cut FROM s WHERE n2 > 0) SELECT node, score, CAST(i > cut AS INTEGER) AS y_hat FROM s, c""")
def kmeans_top_k(spark, d):
    return ranking.two_means_top(results(spark, d), 40)


@query(WITH + a.LOSSES + ", m AS (SELECT day, round(avg(loss), 6) AS adp, round(max(loss), 6) AS discrimination FROM losses WHERE split = 'test' GROUP BY day) SELECT day, adp, discrimination FROM m ORDER BY adp DESC, discrimination DESC, day LIMIT 1")
def best_epoch(spark, d):
    m = a.losses(spark, d).where("split = 'test'").groupBy("day").agg(F.round(F.avg("loss"), 6).alias("adp"), F.round(F.max("loss"), 6).alias("discrimination"))
    return ranking.best_run(m, "day", "adp", "discrimination")


@query(WITH + a.LOSSES + ", m AS (SELECT day, op, avg(loss) AS v FROM losses GROUP BY day, op) SELECT op, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(stddev_pop(v) / (avg(v) + 1e-12) * 100, 6) AS rel_std FROM m GROUP BY op")
def run_stats(spark, d):
    return scoring.run_stats(a.losses(spark, d).groupBy("day", "op").agg(F.avg("loss").alias("v")), "op", "v")


@query(WITH + a.LOSSES + ", c AS (SELECT day, avg(loss) AS y FROM losses GROUP BY day), j AS (SELECT day, round(y, 6) AS y, round(abs(y - lag(y) OVER (ORDER BY day)), 6) AS jump FROM c) SELECT day, y, jump FROM j WHERE jump IS NOT NULL ORDER BY jump DESC, day LIMIT 1")
def largest_jump(spark, d):
    c = a.losses(spark, d).groupBy("day").agg(F.avg("loss").alias("y"))
    return ranking.largest_jump(c, "day", "y").select("day", F.round("y", 6).alias("y"), F.round("jump", 6).alias("jump"))


# rare nodes and queues

IDF = WITH + a.LOSSES + ", m AS (SELECT DISTINCT tw, unnest([src, dst]) AS node FROM losses WHERE split = 'test'), i AS (SELECT node, count(DISTINCT tw) AS df, round(ln((SELECT count(DISTINCT tw) FROM m) / (count(DISTINCT tw) + 1)), 6) AS idf FROM m GROUP BY node)"


def test_members(spark, d):
    """(tw, node) of all windows of the test split."""
    return a.losses(spark, d).where("split = 'test'").select("tw", F.explode(F.array("src", "dst")).alias("node")).distinct()


@query(IDF + " SELECT * FROM i")
def idf(spark, d):
    return q.idf(test_members(spark, d))


@query(IDF + ", r AS (SELECT m.* FROM m JOIN i USING (node) WHERE idf > 1) SELECT x.tw AS a, y.tw AS b, count(*) AS shared FROM r x JOIN r y ON x.node = y.node AND x.tw < y.tw GROUP BY ALL")
def rare_shared_nodes(spark, d):
    m = test_members(spark, d)
    return q.related_windows(m, q.idf(m).where("idf > 1"))


QUEUES = IDF + """, rr AS (SELECT m.* FROM m JOIN i USING (node) WHERE idf > 1.2), rel AS MATERIALIZED (SELECT DISTINCT x.tw AS a, y.tw AS b FROM rr x JOIN rr y ON x.node = y.node AND x.tw < y.tw),
back(tw, first) AS (SELECT tw, tw FROM m UNION SELECT k.tw, rel.a FROM back k JOIN rel ON rel.b = k.first), qs AS (SELECT tw, min(first) AS first FROM back GROUP BY tw), qq AS (SELECT dense_rank() OVER (ORDER BY first) - 1 AS queue, tw FROM qs)"""


def window_queues(spark, d):
    m = test_members(spark, d)
    return q.queues(m, q.chained_windows(m, q.idf(m).where("idf > 1.2")))


@query(QUEUES + " SELECT queue, tw FROM qq")
def queues(spark, d):
    return window_queues(spark, d)


@query(QUEUES + """, lw AS (SELECT tw, avg(loss) / 50 AS loss FROM losses GROUP BY tw), sc AS (SELECT queue, round(exp(sum(ln(loss + 1))), 4) AS score FROM qq JOIN lw USING (tw) GROUP BY queue)
SELECT tw, CASE WHEN score > 20 THEN 1 ELSE 0 END AS y_hat FROM qq JOIN sc USING (queue)""")
def queue_predictions(spark, d):
    members = window_queues(spark, d)
    losses = a.losses(spark, d).groupBy("tw").agg((F.avg("loss") / 50).alias("loss"))
    return q.flagged_windows(members, q.queue_scores(members, losses), 20.0)


# graphs: the edges of one day, or of all days side by side

G = a.PROV + ", g AS (SELECT * FROM prov WHERE day = 27)"


def day27(spark, d):
    return a.prov(spark, d).where("day = 27")


@query("WITH " + a.TRADE + ", u AS (SELECT src, dst, op, t, event_uuid FROM trade) SELECT src, dst, op, t, event_uuid FROM u UNION ALL SELECT dst, src, op, t, event_uuid FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.src = u.dst AND v.dst = u.src)")
def undirected_edges(spark, d):
    return graph.undirected(a.trade(spark, d)).select("src", "dst", "op", "t", "event_uuid")


@query(WITH + a.PROV + ", o AS (SELECT day, src AS node, min(t) AS x FROM prov GROUP BY ALL), i AS (SELECT day, dst AS node, min(t) AS y FROM prov GROUP BY ALL) SELECT day, node FROM o LEFT JOIN i USING (day, node) WHERE y IS NULL OR x < y")
def root_nodes(spark, d):
    return graph.roots(a.prov(spark, d), "day")


@query(WITH + a.PROV + ", n AS (SELECT day, node, sum(o) AS o, sum(i) AS i FROM (SELECT day, src AS node, 1 AS o, 0 AS i FROM prov UNION ALL SELECT day, dst, 0, 1 FROM prov) GROUP BY day, node) SELECT day, node, CAST(o AS BIGINT) AS out, CAST(i AS BIGINT) AS into, round(CASE WHEN i = 0 THEN 0 ELSE o / i END, 6) AS score FROM n")
def degree_scores(spark, d):
    return graph.degree_scores(a.prov(spark, d), "day")


CLOSURE = ", reach(day, seed, node) AS (SELECT DISTINCT day, {a}, {a} FROM prov WHERE {a} % 20 = 0 UNION SELECT r.day, r.seed, e.{b} FROM reach r JOIN prov e ON e.day = r.day AND e.{a} = r.node)"


@query(WITH + a.PROV + CLOSURE.format(a="src", b="dst") + " SELECT day, seed, node FROM reach")
def descendants(spark, d):
    e = a.prov(spark, d)
    return graph.reach_pairs(e, e.where("src % 20 = 0").select("day", F.col("src").alias("node")), "day")


@query(WITH + a.PROV + CLOSURE.format(a="dst", b="src") + " SELECT day, seed, node FROM reach")
def ancestors(spark, d):
    e = a.prov(spark, d)
    return graph.reach_pairs(e, e.where("dst % 20 = 0").select("day", F.col("dst").alias("node")), "day", backward=True)


N_HOP = WITH + a.PROV + ", b AS (SELECT day, src, dst FROM prov UNION SELECT day, dst, src FROM prov), h1 AS (SELECT day, src AS seed, dst AS node FROM b {0}), h2 AS (SELECT h.day, seed, b.dst FROM h1 h JOIN b ON b.day = h.day AND b.src = h.node) SELECT day, seed, node FROM (SELECT DISTINCT day, src AS seed, src AS node FROM b {0} UNION SELECT * FROM h1 UNION SELECT * FROM h2)"


@query(N_HOP.replace("{0}", "WHERE src % 20 = 0"))
def n_hop(spark, d):
    e = a.prov(spark, d)
    seeds = e.select("day", F.explode(F.array("src", "dst")).alias("node")).where("node % 20 = 0").distinct()
    return graph.n_hop(e, seeds, 2, "day")


@query(WITH + a.PROV + """, hops(day, seed, node, hops) AS (SELECT DISTINCT day, src, src, 0 FROM prov WHERE src % 20 = 0 UNION SELECT h.day, h.seed, e.dst, h.hops + 1 FROM hops h JOIN prov e ON e.day = h.day AND e.src = h.node WHERE h.hops < 4)
SELECT day, seed, node, min(hops) AS hops FROM hops GROUP BY day, seed, node""")
def hop_counts(spark, d):
    e = a.prov(spark, d)
    return graph.reach(e, e.where("src % 20 = 0").select("day", F.col("src").alias("node")), "day", max_hops=4)


# the same from every node; the queries above take as seeds every node whose id is divisible by 20


def all_nodes(e):
    return e.select("day", F.explode(F.array("src", "dst")).alias("node")).distinct()


@query()
def descendants_all(spark, d):
    e = a.prov(spark, d)
    return graph.reach_pairs(e, all_nodes(e), "day")


@query()
def ancestors_all(spark, d):
    e = a.prov(spark, d)
    return graph.reach_pairs(e, all_nodes(e), "day", backward=True)


@query(N_HOP.replace("{0}", ""))
def n_hop_all(spark, d):
    e = a.prov(spark, d)
    return graph.n_hop(e, all_nodes(e), 2, "day")


@query()
def hop_counts_all(spark, d):
    e = a.prov(spark, d)
    return graph.reach(e, all_nodes(e), "day", max_hops=None)


ACYC = a.PROV + ", up AS (SELECT * FROM prov WHERE (op = 'WRITE' OR op = 'READ') AND src < dst)"


@query(WITH + a.PROV + """, f AS (SELECT dst AS node, src, t FROM prov), trace(seed, hop, node, t) AS (SELECT DISTINCT dst, 0, dst, CAST(""" + str(DAY27) + """ AS BIGINT) FROM prov WHERE dst % 20 = 0
UNION ALL SELECT seed, hop + 1, n, e_t FROM (SELECT tr.seed, tr.hop, f.src AS n, f.t AS e_t, row_number() OVER (PARTITION BY tr.seed ORDER BY f.t DESC, f.src DESC) AS r FROM trace tr JOIN f ON f.node = tr.node AND f.t < tr.t WHERE tr.hop < 8) WHERE r = 1)
SELECT * FROM trace""")
def temporal_backward(spark, d):
    e = a.prov(spark, d)
    seeds = e.where("dst % 20 = 0").select(F.col("dst").alias("node"), F.lit(DAY27).cast("long").alias("t")).distinct()
    return graph.temporal_trace(e, seeds, max_hops=8)


@query(WITH + a.PROV + """, e AS (SELECT day, src, dst, t, row_number() OVER (PARTITION BY day ORDER BY t, event_uuid) AS i FROM prov), seen AS (SELECT day, node, min(i) AS f FROM (SELECT day, src AS node, i FROM e UNION ALL SELECT day, dst, i FROM e) GROUP BY day, node),
b AS (SELECT e.day, e.dst AS node, e.i FROM e JOIN seen ON seen.day = e.day AND seen.node = e.dst WHERE f < i OR src = dst),
v AS (SELECT e.day, src, (SELECT count(*) FROM b WHERE b.day = e.day AND b.node = e.src AND b.i < e.i) AS src_version, dst, (SELECT count(*) FROM b WHERE b.day = e.day AND b.node = e.dst AND b.i <= e.i) AS dst_version, e.i FROM e)
SELECT day, src, src_version, dst, dst_version, 'edge' AS kind FROM v UNION ALL SELECT v.day, v.dst, dst_version - 1, v.dst, dst_version, 'next' FROM v JOIN b ON b.day = v.day AND b.node = v.dst AND b.i = v.i""")
def versioned_dag(spark, d):
    return graph.versioned(a.prov(spark, d), "day")


@query(WITH + a.PROV + """, o AS (SELECT day, src AS node, min(t) AS x FROM prov GROUP BY ALL), i AS (SELECT day, dst AS node, min(t) AS y FROM prov GROUP BY ALL), roots AS (SELECT day, node FROM o LEFT JOIN i USING (day, node) WHERE y IS NULL OR x < y),
reach(day, seed, node) AS (SELECT day, node, node FROM roots UNION SELECT r.day, r.seed, e.dst FROM reach r JOIN prov e ON e.day = r.day AND e.src = r.node),
n AS (SELECT day, count(*) AS total FROM (SELECT day, src FROM prov UNION SELECT day, dst FROM prov) GROUP BY day), c AS (SELECT day, seed, count(*) AS n FROM reach WHERE node <> seed GROUP BY day, seed)
SELECT day, seed AS root, node FROM reach WHERE node <> seed AND (day, seed) NOT IN (SELECT (c.day, seed) FROM c JOIN n ON n.day = c.day WHERE c.n > 0.5 * total)""")
def pseudo_graph(spark, d):
    return graph.pseudo_graph(a.prov(spark, d), 0.5, "day")


@query(WITH + a.PROV + """, e AS (SELECT DISTINCT day, src, dst FROM prov WHERE src <> dst), up(day, poi, node) AS (SELECT DISTINCT day, dst, dst FROM e WHERE dst % 20 = 0 UNION SELECT u.day, poi, e.src FROM up u JOIN e ON e.day = u.day AND e.dst = u.node),
entries AS (SELECT * FROM up u WHERE node <> poi AND NOT EXISTS (SELECT 1 FROM e JOIN up p ON p.day = e.day AND p.node = e.src AND p.poi = u.poi WHERE e.day = u.day AND e.dst = u.node)),
down(day, entry, node) AS (SELECT DISTINCT day, node, node FROM entries UNION SELECT dn.day, entry, e.dst FROM down dn JOIN e ON e.day = dn.day AND e.src = dn.node)
SELECT en.day, en.poi, en.node AS entry, dn.node FROM entries en JOIN down dn ON dn.day = en.day AND dn.entry = en.node JOIN up ON up.day = en.day AND up.poi = en.poi AND up.node = dn.node""")
def backward_component(spark, d):
    e = a.prov(spark, d)
    return graph.entry_components(e, e.where("dst % 20 = 0").select("day", F.col("dst").alias("node")).distinct(), "day")


def window_results(spark, d):
    """(tw, node, score, y_hat) of the nodes of each test window."""
    return scoring.reduce_losses(test_ends(spark, d), "tw", "node").withColumn("y_hat", (F.col("score") > 300).cast("int"))


def flagged_components(spark, d):
    e = a.losses(spark, d).where("split = 'test'")
    return graph.entry_components(e, window_results(spark, d).where("y_hat = 1").select("tw", "node"), "tw")


@query()
def backward_component_flagged(spark, d):
    return flagged_components(spark, d)


@query()
def triage(spark, d):
    scores = window_results(spark, d)
    pois = scores.where("y_hat = 1").select("tw", "node")
    ranked = graph.ranked_ways(a.losses(spark, d).where("split = 'test'"), pois, scores, "tw")
    return ranked.union(pois.select("tw", F.col("node").alias("poi"), "node")).distinct()  # those without entries too


@query(WITH + a.PROV + ", b AS (SELECT day, src AS node, dst AS neighbour, event_uuid AS e_id, t FROM prov UNION ALL SELECT day, dst, src, event_uuid, t FROM prov) SELECT day, node, neighbour, e_id FROM (SELECT *, row_number() OVER (PARTITION BY day, node ORDER BY t DESC, e_id DESC, neighbour) AS r FROM b) WHERE r <= 5")
def last_neighbours(spark, d):
    return graph.last_neighbours(a.prov(spark, d), 5, "day")


@query(WITH + a.PROV + ", x AS (SELECT day AS batch, node, max(t) AS latest FROM (SELECT day, t, unnest([src, dst]) AS node FROM prov) GROUP BY ALL) SELECT * FROM (SELECT batch, node, lag(latest) OVER (PARTITION BY node ORDER BY batch) AS t FROM x) WHERE t IS NOT NULL")
def last_update(spark, d):
    return graph.last_update(a.prov(spark, d).withColumn("batch", F.col("day"))).where("t IS NOT NULL")


@query(WITH + a.PROV + ",\n" + a.NODES + """, files AS (SELECT node_id AS file, row_number() OVER (ORDER BY md5('0|' || node_id), node_id) - 1 AS r, count(*) OVER () AS total FROM nodes WHERE node_type = 'file'),
known AS (SELECT src AS node, dst AS file FROM prov UNION SELECT dst, src FROM prov), p AS (SELECT node_id AS node, ('0x' || substr(md5('0|' || node_id), 1, 15))::BIGINT AS h FROM nodes WHERE node_type = 'subject'),
x AS (SELECT node, file, (r - h % total + total) % total AS k FROM p, files WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.node = p.node AND known.file = files.file))
SELECT node AS src, file AS dst, unnest(['OPEN', 'READ', 'WRITE']) AS op FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY k) AS n FROM x) WHERE n <= 20""")
def synthetic_attacks(spark, d):
    e = a.prov(spark, d)
    n = a.nodes(e)
    return graph.synthetic_attacks(e, n.where("node_type = 'subject'").select(F.col("node_id").alias("node")), n.where("node_type = 'file'").select(F.col("node_id").alias("node")))


# text and features


@query("SELECT page_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/')), '|') AS prefixes FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)")
def path_prefixes(spark, d):
    return a.table(spark, d, "pages").select("page_id", F.array_join(text.prefixes(F.col("url"), "/"), "|").alias("prefixes"))


@query(r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(replace(regexp_replace(url, '\\+', '/', 'g'), '/', ' / '), '[ \t\r\n]+'), lambda x: x <> ''), '|') AS tokens FROM pages")
def tokens(spark, d):
    return a.table(spark, d, "pages").select("page_id", F.array_join(text.path_tokens(F.col("url")), "|").alias("tokens"))


@query(r"""WITH p AS (SELECT page_id, len(list_filter(regexp_split_to_array(replace(regexp_replace(url, '\\+', '/', 'g'), '/', ' / '), '[ \t\r\n]+'), lambda x: x <> '')) AS n FROM pages)
SELECT page_id, CAST(i AS INTEGER) AS i, round(1.0::DOUBLE / n + 30 / (100.0 * n) * (n - 1) / 2 - i * 30 / (100.0 * n), 6) AS w FROM p, LATERAL (SELECT range AS i FROM range(0, n))""")
def token_weights(spark, d):
    n = F.size(text.path_tokens(F.col("url")))
    return a.table(spark, d, "pages").select("page_id", F.posexplode(text.token_weights(n, 30)).alias("i", "w")).select("page_id", "i", F.round("w", 6).alias("w"))


@query(WITH + a.PROV + ",\n" + a.NODES + " SELECT label, min(node_id) AS node_id FROM nodes GROUP BY label")
def corpus_labels(spark, d):
    return a.nodes(a.prov(spark, d)).groupBy("label").agg(F.min("node_id").alias("node_id"))


TRIPLET_SQL = ", tr(src_type, dst_type, op, triplet) AS (VALUES " + ", ".join(f"('{s}', '{t}', '{op}', {i})" for i, (s, t, op) in enumerate((s, t, op) for (s, t), ops in features.TRIPLETS.items() for op in ops)) + ")"


@query(WITH + a.PROV + ",\n" + a.NODES + TRIPLET_SQL + " SELECT event_uuid, coalesce(triplet, 0) AS triplet FROM prov JOIN nodes s ON s.node_id = src JOIN nodes d ON d.node_id = dst LEFT JOIN tr ON tr.src_type = s.node_type AND tr.dst_type = d.node_type AND tr.op = 'EVENT_' || prov.op")
def triplets(spark, d):
    e = a.prov(spark, d)
    n = a.nodes(e)
    rows = e.join(n.select(F.col("node_id").alias("src"), F.col("node_type").alias("src_type")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type")), "dst")
    return features.with_triplets(rows.withColumn("op", F.concat(F.lit("EVENT_"), "op")), features.triplet_table(spark)).select("event_uuid", "triplet")


TYPES = ["READ", "OPEN", "WRITE", "CONNECT", "RECVFROM"]


@query(WITH + a.PROV + ", x AS (SELECT day, src AS node, op, 'out' AS way FROM prov UNION ALL SELECT day, dst, op, 'in' FROM prov), c AS (SELECT day, node, " + ", ".join(f"count(*) FILTER (op = '{t}' AND way = '{w}') AS {w}_{t}" for w in ("out", "in") for t in TYPES) + " FROM x GROUP BY day, node) SELECT day, node, " + ", ".join(f"round(CASE WHEN max({w}_{t}) OVER (PARTITION BY day) = 0 THEN 0 ELSE {w}_{t} / max({w}_{t}) OVER (PARTITION BY day) END, 6) AS {w}_{t}" for w in ("out", "in") for t in TYPES) + " FROM c")
def type_distribution(spark, d):
    return features.type_distribution(a.prov(spark, d), TYPES, "day")


@query("WITH f AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), s AS (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM f GROUP BY i) SELECT vec_id, i, round((x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 5) AS z FROM f JOIN s USING (i)")
def z_vectors(spark, d):
    return features.z_scores(a.table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", "vec_id")


@query("SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(min(n), 6) AS min, round(max(n), 6) AS max FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)")
def vector_norms(spark, d):
    return features.norm_stats(a.table(spark, d, "embeddings"), "embedding")


PAIRS = "WITH p AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


@query(PAIRS + """ SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a), 6) AS mse, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / len(a), 6) AS mae,
round(pow(1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 3), 5) AS sce FROM p""")
def sce_mse_mae(spark, d):
    e = a.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    p = e.select("vec_id", F.col("e").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b")), "vec_id")
    return p.select("vec_id", F.round(scoring.mse("a", "b"), 6).alias("mse"), F.round(scoring.mae("a", "b"), 6).alias("mae"), F.round(scoring.sce("a", "b"), 5).alias("sce"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.vec_id, y.vec_id AS r, sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0)
SELECT vec_id, round(avg(d), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, r) AS n FROM p) WHERE n <= 10 GROUP BY vec_id""")
def knn_score(spark, d):
    e = a.table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return features.knn_scores(e, e.where("vec_id % 20 = 0"))


@query("WITH p AS (SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS p FROM embeddings) SELECT vec_id, round(greatest(ln(p[1] / CASE WHEN p[2] = 0 THEN 1e-5 ELSE p[2] END), 0), 6) AS threatrace, round((p[1] - p[2]) / (p[1] + 1e-6), 6) AS flash FROM p")
def confidence_scores(spark, d):
    e = a.table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("p"))
    return e.select("vec_id", F.round(scoring.threatrace_score("p"), 6).alias("threatrace"), F.round(scoring.flash_confidence("p"), 6).alias("flash"))


@query("SELECT count(DISTINCT h) AS hosts, (SELECT count(*) FROM lineitem) AS flows FROM (SELECT l_partkey AS h FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)")
def host_counts(spark, d):
    return features.host_counts(a.table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


# summaries of series


#: Gaps of one edge that a stream clustering follows, point by point: longer series are sampled, as in the original.
SERIES = 50_000


def sampled_gaps(spark, d):
    g = windows.gaps(a.prov(spark, d), "src", "op").withColumn("gap", F.col("gap") / 1e9)
    return reduction.sample_long(g, SERIES, 0, "src", "op", by="t")


@query()
def stream_clusters(spark, d):
    return summaries.stream_clusters(sampled_gaps(spark, d), "gap", "src", "op")


KS = GAPS.replace("(PARTITION BY src, op ORDER BY t, event_uuid)) / 1e9 AS gap FROM prov)", "(PARTITION BY src, op ORDER BY t, event_uuid)) / 1e9 AS gap, day FROM prov)")


@query(KS + """, x AS (SELECT op, gap, CAST(sum(CASE WHEN day <= 15 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN day > 15 THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM gg GROUP BY op, gap)
SELECT op, round(max(d), 6) AS ks FROM (SELECT op, abs(sum(a) OVER u / sum(a) OVER w - sum(b) OVER u / sum(b) OVER w) AS d FROM x WINDOW u AS (PARTITION BY op ORDER BY gap), w AS (PARTITION BY op)) GROUP BY op""")
def gap_drift(spark, d):
    g = windows.gaps(a.prov(spark, d).withColumn("key", F.struct("src", "op")), "key").select("key.op", "t", (F.col("gap") / 1e9).alias("gap"))
    day = F.floor(F.col("t") / a.DAY) - a.EPOCH_DAY + 1
    return summaries.ks_drift(g.where(day <= 15), g.where(day > 15), "gap", "op").select("op", F.round("ks", 6).alias("ks"))


@query(WITH + a.PROV + """, h AS (SELECT event_uuid, op, CAST(value > 90 AS INTEGER) AS hit, row_number() OVER u AS n, sum(CAST(value > 90 AS INTEGER)) OVER u AS s FROM prov WINDOW u AS (PARTITION BY op ORDER BY t, event_uuid))
SELECT event_uuid, op, hit, round(0.2 * s - n * ln(1 - 0.1 + 0.1 * exp(0.2)), 6) AS log_m FROM h""")
def value_martingale(spark, d):
    hits = a.prov(spark, d).select("event_uuid", "op", "t", (F.col("value") > 90).cast("int").alias("hit"))
    return summaries.martingale(hits, 0.1, 0.2, "op").select("event_uuid", "op", "hit", F.round("log_m", 6).alias("log_m"))


@query()
def corpus_vectors(spark, d):
    e = a.prov(spark, d)
    c = summaries.corpus(e, a.nodes(e), text.path_tokens)
    return summaries.word_vectors(c, dims=8).getVectors().select("word", vector_to_array("vector").alias("vector"))


@query()
def hashed_labels(spark, d):
    n = a.nodes(a.prov(spark, d))
    return n.select("node_id", text.hashed(text.prefixes(F.col("label"), "/"), 16).alias("vec")).select("node_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("SELECT 'alpha' AS probe, x.n AS inner_rows, y.n AS left_rows, z.n AS anti_rows FROM (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') x, (SELECT count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey) y, (SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) z")
def join_kinds(spark, d):
    o, c = a.table(spark, d, "orders"), a.table(spark, d, "customer")
    n = F.count(F.lit(1))
    inner = o.join(c.where("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey).agg(n.alias("inner_rows"))
    left = c.join(o, o.o_custkey == c.c_custkey, "left").agg(n.alias("left_rows"))
    anti = c.join(o, o.o_custkey == c.c_custkey, "left_anti").agg(n.alias("anti_rows"))
    return inner.join(left, F.lit(True)).join(anti, F.lit(True)).select(F.lit("alpha").alias("probe"), "inner_rows", "left_rows", "anti_rows")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark, d):
    return a.table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

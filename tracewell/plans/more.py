"""Further named queries: filters, set operations, comparisons, neighbours as of a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import features, filters, graph, labels, reduction, scoring, windows
from tracewell.plans.catalogue import RESULTS, WITH, query, results, test_ends
from tracewell.sources import adapters as a

CONTAINS = " OR ".join(f"contains(label, '{k}')" for k in filters.KEYWORDS)
LEGACY = " OR ".join(f"contains(label, '{k}')" for k in filters.LEGACY_KEYWORDS)


@query(WITH + a.PROV + ",\n" + a.NODES + f" SELECT node_id, ({CONTAINS}) AS benign, ({LEGACY}) AS legacy FROM (SELECT node_id, CASE WHEN node_id % 4 = 0 THEN '/usr' || label ELSE label END AS label FROM nodes)")
def keyword_flags(spark, d):
    n = a.nodes(a.prov(spark, d)).withColumn("label", F.when(F.col("node_id") % 4 == 0, F.concat(F.lit("/usr"), "label")).otherwise(F.col("label")))
    return n.select("node_id", filters.benign(F.col("label")).alias("benign"), filters.benign(F.col("label"), filters.LEGACY_KEYWORDS).alias("legacy"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_replace(p_brand || '_' || p_size, '_[^_]*$', '') IN ('Brand#11', 'Brand#12', 'Brand#23')")
def target_nodes(spark, d):
    t = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#23",)], "target string")
    p = a.table(spark, d, "part").withColumn("name2", F.concat_ws("_", "p_brand", F.col("p_size").cast("string")))
    return filters.to_targets(p, t, "name2").select("p_partkey", "p_name")


MID = a.EPOCH_DAY * a.DAY + 15 * a.DAY


@query(WITH + a.PROV + f" SELECT src, op, count(*) FILTER (t <= {MID}) AS before, count(*) FILTER (t > {MID}) AS after FROM prov GROUP BY src, op")
def time_split_counts(spark, d):
    m = filters.time_split(reduction.merged_edges(a.prov(spark, d), "src", "op"), MID, MID)
    return m.select("src", "op", F.size("before").cast("long").alias("before"), F.size("after").cast("long").alias("after"))


@query(WITH + a.PROV + " SELECT event_uuid, day FROM (SELECT event_uuid, day, row_number() OVER (PARTITION BY day ORDER BY t, event_uuid) AS n FROM prov) WHERE n <= 21")
def test_mode_events(spark, d):
    return filters.first_rows(a.prov(spark, d), 21, "day").select("event_uuid", "day")


CLASS = "CASE WHEN y = 1 AND {s} > {t} THEN 'TP' WHEN {s} > {t} THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END"


@query(RESULTS + f", m AS (SELECT node, avg(loss) AS mean FROM ends GROUP BY node), c AS (SELECT node, {CLASS.format(s='score', t=300)} AS a, {CLASS.format(s='mean', t=50)} AS b FROM results JOIN m USING (node)) SELECT node, a, b FROM c WHERE a <> b")
def config_compare(spark, d):
    r = results(spark, d)
    mean = labels.mark(scoring.reduce_losses(test_ends(spark, d), "node", how="mean"), a.attack_nodes(spark).withColumnRenamed("node_id", "node"), ["node"])
    one = scoring.classified(r.withColumn("y_hat", (F.col("score") > 300).cast("int")))
    two = scoring.classified(mean.withColumn("y_hat", (F.col("score") > 50).cast("int")))
    return filters.disagreements(one, two)


@query(WITH + a.PROV + """, ends AS (SELECT day AS batch, t, event_uuid, src AS node, dst AS neighbour FROM prov UNION ALL SELECT day, t, event_uuid, dst, src FROM prov),
b AS (SELECT DISTINCT batch, node FROM ends), j AS (SELECT b.batch, b.node, e.neighbour, e.event_uuid AS e_id, row_number() OVER (PARTITION BY b.batch, b.node ORDER BY e.batch DESC, e.t DESC, e.event_uuid DESC, e.neighbour DESC) AS r FROM b JOIN ends e ON e.node = b.node AND e.batch < b.batch)
SELECT batch, node, neighbour, e_id FROM j WHERE r <= 3""")
def as_of_neighbours(spark, d):
    return filters.as_of_neighbours(a.prov(spark, d).withColumn("batch", F.col("day")), 3)


@query(WITH + a.PROV + """, ends AS (SELECT day, t, event_uuid, op, src AS node, dst AS other FROM prov UNION ALL SELECT day, t, event_uuid, op, dst, src FROM prov), k AS (SELECT *, row_number() OVER (PARTITION BY day, node ORDER BY t, event_uuid, other) AS r FROM ends)
SELECT day, node, string_agg(op || '|' || other, '|' ORDER BY r) AS props FROM k WHERE r <= 5 GROUP BY day, node""")
def node_properties(spark, d):
    return filters.capped_properties(a.prov(spark, d), 5, "day").select("day", "node", F.array_join("props", "|").alias("props"))


@query(WITH + a.PROV + " SELECT day, count(*) AS batches, CAST(sum(edges) AS BIGINT) AS edges, round(sum(ms), 3) AS ms, round(avg(ms), 6) AS mean_ms FROM (SELECT day, t // 3600000000000 AS h, count(*) AS edges, sum(value) AS ms FROM prov GROUP BY ALL) GROUP BY day")
def batch_summary(spark, d):
    e = windows.fixed_windows(a.prov(spark, d), a.HOUR).groupBy("day", "tw").agg(F.count(F.lit(1)).alias("edges"), F.sum("value").alias("ms"))
    return filters.batch_summary(e, "day")


@query(WITH + a.PROV + " SELECT day, round(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) / 1e9 ELSE 0 END, 6) AS mean_gap, min(t) AS first_t, max(t) AS last_t FROM prov GROUP BY day")
def mean_time_gaps(spark, d):
    return filters.mean_gaps(a.prov(spark, d), "day")


@query(RESULTS + " SELECT threshold, round(100 * avg(CASE WHEN score >= threshold THEN 1 ELSE 0 END), 6) AS fp_percent FROM results, (SELECT min(score) AS threshold FROM results WHERE y = 1) WHERE y = 0 GROUP BY threshold")
def full_recall_threshold(spark, d):
    return filters.full_recall_threshold(results(spark, d))


@query(WITH + a.LOSSES + " SELECT src FROM losses WHERE split = 'train' AND op = 'WRITE' INTERSECT SELECT src FROM losses WHERE split = 'val' AND op = 'WRITE'")
def shared_writers(spark, d):
    e = a.losses(spark, d).where("op = 'WRITE'")
    return e.where("split = 'train'").select("src").intersect(e.where("split = 'val'").select("src"))


@query(WITH + a.LOSSES + " SELECT split, count(DISTINCT node) AS nodes FROM (SELECT split, unnest([src, dst]) AS node FROM losses) GROUP BY split")
def split_nodes(spark, d):
    return a.losses(spark, d).select("split", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("split").agg(F.count(F.lit(1)).alias("nodes"))


@query(WITH + a.LOSSES + " SELECT unnest([src, dst]) AS node FROM losses WHERE split = 'test' EXCEPT SELECT unnest([src, dst]) FROM losses WHERE split <> 'test'")
def new_nodes(spark, d):
    e = a.losses(spark, d).select("split", F.explode(F.array("src", "dst")).alias("node"))
    return e.where("split = 'test'").select("node").distinct().join(e.where("split != 'test'").select("node").distinct(), "node", "left_anti")


SCALED = WITH + a.PROV + """, n AS (SELECT day, node, sum(o) / nullif(sum(i), 0) AS s FROM (SELECT day, src AS node, 1 AS o, 0 AS i FROM prov UNION ALL SELECT day, dst, 0, 1 FROM prov) GROUP BY day, node), r AS (SELECT day, node, round(coalesce(s, 0), 6) AS s FROM n)
SELECT day, node, round(coalesce((s - min(s) OVER (PARTITION BY day)) / nullif(max(s) OVER (PARTITION BY day) - min(s) OVER (PARTITION BY day), 0), 0), 5) AS score FROM r"""


@query(SCALED)
def degree_scaled(spark, d):
    scores = graph.degree_scores(a.prov(spark, d), "day").select("day", "node", "score")
    return graph.min_max(scores, "score", "day").select("day", "node", F.round("score", 5).alias("score"))


@query(WITH + a.PROV + ",\n" + a.NODES + " SELECT node_id, CASE node_type WHEN 'subject' THEN 1 WHEN 'file' THEN 2 ELSE 3 END AS type_id, CASE node_type WHEN 'subject' THEN '1,0,0' WHEN 'file' THEN '0,1,0' ELSE '0,0,1' END AS one_hot FROM nodes")
def type_one_hot(spark, d):
    i = F.when(F.col("node_type") == "subject", 1).when(F.col("node_type") == "file", 2).otherwise(3)
    return a.nodes(a.prov(spark, d)).select("node_id", i.alias("type_id"), F.array_join(F.transform(text.one_hot(i - 1, 3), lambda x: x.cast("string")), ",").alias("one_hot"))


@query("WITH f AS (SELECT label, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) SELECT label AS tw, CAST(node AS BIGINT) AS node, i, round(avg(x), 6) AS mean FROM (SELECT label, label AS node, i, x FROM f UNION ALL SELECT label, label + 1, i, x FROM f) GROUP BY ALL")
def scatter_means(spark, d):
    e = a.table(spark, d, "embeddings").select(F.col("label").alias("tw"), F.col("label").cast("long").alias("src"), (F.col("label") + 1).cast("long").alias("dst"), F.col("embedding").cast("array<double>").alias("v"))
    return features.scatter_mean(e, "v", "tw")


@query(WITH + a.PROV + " SELECT event_uuid, src, op FROM (SELECT *, row_number() OVER (PARTITION BY src, op ORDER BY t DESC, event_uuid DESC) AS r FROM prov) WHERE r <= 8")
def capped_buffers(spark, d):
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy("src", "op").orderBy(F.desc("t"), F.desc("event_uuid")))
    return a.prov(spark, d).withColumn("r", r).where("r <= 8").select("event_uuid", "src", "op")


@query(WITH + a.PROV + ", c AS (SELECT day, op, count(*) AS n FROM prov GROUP BY ALL) SELECT day, arg_min(op, (n, op)) AS least, arg_max(op, (n, op)) AS most FROM c GROUP BY day")
def extreme_runs(spark, d):
    c = a.prov(spark, d).groupBy("day", "op").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("day").agg(F.min_by("op", F.struct("n", "op")).alias("least"), F.max_by("op", F.struct("n", "op")).alias("most"))


DRAW = "('0x' || substr(md5('0|{salt}|' || id), 1, 15))::BIGINT"


@query(WITH + a.PROV + ",\n" + a.NODES + f""", ranked AS (SELECT node_type, node_id, row_number() OVER (PARTITION BY node_type ORDER BY md5('0|' || node_id), node_id) - 1 AS r, count(*) OVER (PARTITION BY node_type) AS n FROM nodes), procs AS (SELECT * FROM ranked WHERE node_type = 'subject'), files AS (SELECT * FROM ranked WHERE node_type = 'file'),
span AS (SELECT min(t) AS lo, max(t) AS hi FROM prov), tries AS (SELECT id, lo + {DRAW.format(salt='t')} % (hi - lo + 1) AS start, [['OPEN', 'READ'], ['OPEN', 'WRITE'], ['OPEN', 'READ', 'WRITE'], ['OPEN', 'WRITE', 'READ']][1 + {DRAW.format(salt='k')} % 4] AS ops FROM range(200) t(id), span)
SELECT p.node_id AS src, f.node_id AS dst, ops[i] AS op, start + i - 1 AS t FROM (SELECT *, unnest(range(1, len(ops) + 1)) AS i FROM tries) JOIN procs p ON p.r = {DRAW.format(salt='p')} % p.n JOIN files f ON f.r = {DRAW.format(salt='f')} % f.n""")
def mimicry_events(spark, d):
    e = a.prov(spark, d)
    n = a.nodes(e)
    templates = [["OPEN", "READ"], ["OPEN", "WRITE"], ["OPEN", "READ", "WRITE"], ["OPEN", "WRITE", "READ"]]
    return filters.mimicry(e, n.where("node_type = 'subject'").select(F.col("node_id").alias("node")), n.where("node_type = 'file'").select(F.col("node_id").alias("node")), templates, 200)

"""Further named queries: vectors and messages of edges, audit logs read back, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import audit_trail, graph, queues as q, reduction, reports, scoring, vectors
from tracewell.operators.storage import new_path
from tracewell.plans.catalogue import ENDS, GAPS, RESULTS, TYPES, WITH, gap_seconds, query, results, test_ends, test_members
from tracewell.sources import adapters as a
from tracewell.sources import audit_logs as logs

NODES, WEIGHTS = vectors.quadrature()
PI = "3.141592653589793::DOUBLE"
VECTORS = GAPS + """, pos AS (SELECT src, op, gap AS x FROM gg WHERE gap > 0), keys AS (SELECT DISTINCT src, op FROM gg),
st AS (SELECT src, op, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mean, stddev_pop(x) AS std, stddev_samp(x) AS s, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) - min(x) AS range FROM pos GROUP BY src, op HAVING count(*) > 1 AND stddev_samp(x) > 0),
j AS (SELECT pos.*, n, mean, std, s, n ** (-0.2::DOUBLE) * s AS h FROM pos JOIN st USING (src, op)),
p AS (SELECT src, op, avg((x - mean) ** 3) / any_value(std) ** 3 AS skew, avg((x - mean) ** 4) / any_value(std) ** 4 - 3 AS kurt, """ + ", ".join(
    f"{WEIGHTS[i]!r}::DOUBLE * avg(exp(-0.5::DOUBLE * ((greatest(mean + CASE WHEN std < 1e-6 THEN 1 ELSE std END * 1.4142135623730951::DOUBLE * ({NODES[i]!r}::DOUBLE), 1e-6::DOUBLE) - x) / h) ** 2) / (h * 2.5066282746310002::DOUBLE)) AS kde{i}" for i in range(5)
) + ", " + ", ".join(f"avg({f}(2 * {PI} * {k} * x / (mean + 1e-6::DOUBLE))) AS {f}{k}" for k in (1, 2, 3) for f in ("cos", "sin")) + " FROM j GROUP BY src, op),\nv AS (SELECT * FROM keys LEFT JOIN st USING (src, op) LEFT JOIN p USING (src, op))"
DIGITS = {**{f"kde{i}": 9 for i in range(5)}, "mean": 3, "std": 3, "skew": 5, "kurt": 5, **{f"{f}{k}": 6 for k in (1, 2, 3) for f in ("cos", "sin")}, "q25": 3, "q50": 3, "q75": 3, "n": 0, "range": 3}


def gap_vectors(spark, d):
    return vectors.time_vectors(gap_seconds(spark, d), "gap", "src", "op")


@query(VECTORS + " SELECT src, op, " + ", ".join(f"coalesce(round({c}, {n}), 0) AS {c}" for c, n in DIGITS.items()) + " FROM v")
def edge_time_vectors(spark, d):
    v = gap_vectors(spark, d)
    return v.select("src", "op", *(F.round(c, n).alias(c) for c, n in DIGITS.items()))


@query(VECTORS + " SELECT event_uuid, v.src IS NOT NULL AS known, coalesce(round(mean, 3), 0) AS mean, coalesce(n, 0) AS n FROM prov LEFT JOIN v ON v.src = prov.src AND v.op = prov.op")
def edges_with_vectors(spark, d):
    e = vectors.with_vectors(a.prov(spark, d), gap_vectors(spark, d), "src", "op")
    at = {c: i for i, c in enumerate(vectors.PARTS)}
    return e.select("event_uuid", "known", F.round(F.get("vector", F.lit(at["mean"])), 3).alias("mean"), F.get("vector", F.lit(at["n"])).alias("n"))


KINDS = ["subject", "file", "netflow"]
KIND_OF = "CASE WHEN {0} < 1000000 THEN 0 WHEN ({0} - 1000000) % 3 = 0 THEN 2 ELSE 1 END"


def typed_edges(spark, d):
    e = a.prov(spark, d)
    n = a.nodes(e)
    return e.join(n.select(F.col("node_id").alias("src"), F.col("node_type").alias("src_type")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type")), "dst")


@query(WITH + a.PROV + f""", k AS (SELECT event_uuid, {KIND_OF.format('src')} AS s, {KIND_OF.format('dst')} AS d, list_position(['READ', 'OPEN', 'WRITE', 'CONNECT', 'RECVFROM'], op) - 1 AS o FROM prov)
SELECT event_uuid, array_to_string(list_concat(list_transform(range(3), lambda i: CAST(i = s AS INTEGER)), list_transform(range(5), lambda i: CAST(i = o AS INTEGER)), list_transform(range(3), lambda i: CAST(i = d AS INTEGER))), '') AS msg, CAST(o AS INTEGER) AS edge_type, CAST(s AS INTEGER) AS src_type, CAST(d AS INTEGER) AS dst_type, 11 + 5 AS width FROM k""")
def edge_messages(spark, d):
    m = vectors.messages(typed_edges(spark, d), KINDS, TYPES)
    f = vectors.fields(F.col("msg"), len(KINDS), len(TYPES))
    whole = vectors.edge_features(f, F.col("msg"), ["edge_type", "msg"])
    return m.select("event_uuid", F.array_join(F.transform("msg", lambda x: x.cast("int").cast("string")), "").alias("msg"), *(vectors.argmax(f[c]).alias(c) for c in ("edge_type", "src_type", "dst_type")), F.size(whole).alias("width"))


@query(WITH + a.PROV + """, x AS (SELECT day AS batch, node, max(t) AS latest FROM (SELECT day, t, unnest([src, dst]) AS node FROM prov) GROUP BY ALL), l AS (SELECT batch, node, lag(latest) OVER (PARTITION BY node ORDER BY batch) AS last FROM x)
SELECT event_uuid, last - t AS dt FROM prov JOIN l ON l.batch = day AND l.node = src""")
def relative_times(spark, d):
    e = a.prov(spark, d).withColumn("batch", F.col("day"))
    return reports.relative_times(e, graph.last_update(e)).select("event_uuid", "dt")


@query(WITH + a.LOSSES + """, t AS (SELECT *, (SELECT quantile_cont(loss, 0.9) FROM losses WHERE split = 'val') AS threshold FROM losses WHERE split = 'test'), hot AS (SELECT * FROM t WHERE loss > threshold)
SELECT tw, round(min(threshold), 6) AS threshold, count(*) FILTER (loss > threshold) AS n, round(coalesce(avg(loss) FILTER (loss > threshold), 0), 6) AS mean_loss, (SELECT count(DISTINCT node) FROM (SELECT unnest([src, dst]) AS node FROM hot WHERE hot.tw = t.tw)) AS nodes,
(SELECT count(*) FROM (SELECT DISTINCT src, dst, op FROM hot WHERE hot.tw = t.tw)) AS edges FROM t GROUP BY tw""")
def window_anomalies_fixed(spark, d):
    e = a.losses(spark, d)
    level = e.where("split = 'val'").agg(F.percentile("loss", F.lit(0.9)).alias("threshold"))
    return scoring.over_threshold(e.where("split = 'test'").join(F.broadcast(level), F.lit(True)))


@query(WITH + a.PROV + """, e AS (SELECT day, count(*) AS e FROM prov GROUP BY day), n AS (SELECT day, count(DISTINCT node) AS n FROM (SELECT day, unnest([src, dst]) AS node FROM prov) GROUP BY day)
SELECT count(*) AS graphs, round(avg(e), 6) AS mean_edges, min(e) AS min_edges, max(e) AS max_edges, round(avg(n), 6) AS mean_nodes, min(n) AS min_nodes, max(n) AS max_nodes FROM e JOIN n USING (day)""")
def graph_sizes(spark, d):
    return reports.graph_sizes(a.prov(spark, d), "day")


BATCHES = WITH + a.LOSSES + ", b AS (SELECT tw, count(*) AS edges, sum(loss) AS ms, max(loss) AS top FROM losses GROUP BY tw)"


@query(BATCHES + " SELECT tw, edges, round(ms, 3) AS ms FROM b WHERE tw IN (SELECT tw FROM losses WHERE op = 'RECVFROM' AND loss > 300)")
def tainted_batches(spark, d):
    e = a.losses(spark, d)
    base = e.groupBy("tw").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("loss"), 3).alias("ms"))
    return reports.tainted(base, e, (F.col("op") == "RECVFROM") & (F.col("loss") > 300), "tw")


@query(RESULTS + ", m AS (SELECT DISTINCT tw, node FROM ends) SELECT tw, node, score, y FROM m JOIN results USING (node)")
def results_by_window(spark, d):
    return reports.results_by_window(results(spark, d), test_ends(spark, d)).select("tw", "node", "score", "y")


@query(WITH + a.PROV + " SELECT src AS node, dst AS neighbour, event_uuid AS e_id FROM prov UNION ALL SELECT dst, src, event_uuid FROM prov WHERE event_uuid % 3 = 0 AND src <> dst")
def repaired_neighbours(spark, d):
    e = a.prov(spark, d)
    right = e.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.col("event_uuid").alias("e_id"))
    turned = e.where("event_uuid % 3 = 0 AND src <> dst").select("dst", "src", "event_uuid")
    wrong = e.select("src", (F.col("dst") + 5_000_000).alias("neighbour"), "event_uuid")
    return reports.repaired(right.union(turned).union(wrong), e).select("node", "neighbour", "e_id")


@query(WITH + a.PROV + ",\n" + a.NODES + " SELECT node_id, label FROM nodes WHERE node_id IN (SELECT unnest([src, dst]) FROM prov WHERE op = 'WRITE')")
def used_node_labels(spark, d):
    e = a.prov(spark, d)
    return reports.used_nodes(a.nodes(e), e.where("op = 'WRITE'")).select("node_id", "label")


@query("WITH " + a.TRADE + ", m AS (SELECT src, dst, op, count(*) AS n FROM trade GROUP BY ALL HAVING count(*) >= 10) SELECT src, dst, op, n, row_number() OVER (ORDER BY n, src, dst, op) AS rank FROM m")
def edges_by_count(spark, d):
    return reports.by_count(reduction.merged_edges(a.trade(spark, d), "src", "dst", "op"), 10, "src", "dst", "op")


@query("SELECT page_id, CAST(regexp_replace(url, '[^0-9]', '', 'g') AS BIGINT) AS key FROM pages WHERE regexp_replace(url, '[^0-9]', '', 'g') <> '' AND length(regexp_replace(url, '[^0-9]', '', 'g')) < 18")
def numeric_keys(spark, d):
    digits = F.regexp_replace("url", "[^0-9]", "")
    return a.table(spark, d, "pages").where((digits != "") & (F.length(digits) < 18)).select("page_id", reports.numeric_key(F.col("url")).cast("long").alias("key"))


@query(WITH + a.PROV + ",\n" + a.NODES + " SELECT DISTINCT label AS node FROM nodes")
def merged_pseudo_nodes(spark, d):
    n = a.nodes(a.prov(spark, d))
    both = n.select(F.col("label").alias("node")).union(n.where("node_id % 2 = 0").select(F.concat(F.lit("pseudo_"), "label")))
    return reports.merged_pseudo(both, "node")


@query(ENDS + " SELECT node, CAST(floor(max(loss)) AS BIGINT) AS score FROM ends GROUP BY node")
def whole_node_scores(spark, d):
    return scoring.reduce_losses(test_ends(spark, d), "node").select("node", F.floor("score").alias("score"))


@query(WITH + a.PROV + ",\n" + a.NODES + " SELECT DISTINCT src AS u, dst AS v, op, s.node_type AS u_type, d.node_type AS v_type FROM prov JOIN nodes s ON s.node_id = src JOIN nodes d ON d.node_id = dst")
def adjacency(spark, d):
    e = a.prov(spark, d)
    return reports.adjacency(e, a.nodes(e))


@query(WITH + a.LOSSES + """, m AS (SELECT DISTINCT tw, unnest([src, dst]) AS node FROM losses WHERE split = 'test'), w AS (SELECT count(DISTINCT tw) AS n FROM m), i AS (SELECT node, round(ln((SELECT n FROM w) / (count(*) + 1)), 6) AS idf FROM m GROUP BY node),
r AS (SELECT m.* FROM m JOIN i USING (node) WHERE idf > ln(0.1 * (SELECT n FROM w))) SELECT x.tw AS a, y.tw AS b, count(*) AS shared FROM r x JOIN r y ON x.node = y.node AND x.tw < y.tw GROUP BY ALL""")
def legacy_relations(spark, d):
    """Windows that share nodes whose weight is above the logarithm of a share of all windows."""
    m = test_members(spark, d)
    total = m.agg(F.log(0.1 * F.count_distinct("tw")).alias("level"))
    rare = q.idf(m).join(F.broadcast(total), F.lit(True)).where("idf > level")
    return q.related_windows(m, rare)


@query(RESULTS + ", level AS (SELECT avg(score) AS level FROM (SELECT score FROM results WHERE y = 0 ORDER BY score DESC, node LIMIT 10)) SELECT attack_id, count(*) FILTER (score > level) AS tps FROM attack_nodes LEFT JOIN results ON node = node_id, level GROUP BY attack_id")
def discrimination_tps(spark, d):
    return reports.discrimination_tps(results(spark, d), a.attack_nodes(spark), 10)


@query("SELECT page_id, translate(coalesce(url, ''), ' \"', '__') AS token, CASE WHEN trim(coalesce(url, '')) IN ('', 'N/A') THEN '/none' ELSE trim(url) END AS path, lower(hex(encode(CASE WHEN coalesce(url, '') = '' THEN 'unknown' ELSE url END))) AS title FROM pages")
def audit_values(spark, d):
    u = F.col("url")
    return a.table(spark, d, "pages").select("page_id", reports.audit_token(u).alias("token"), reports.audit_path(u, "/none").alias("path"), reports.audit_title(u).alias("title"))


@query(WITH + a.LOSSES + " SELECT split, tw, count(*) AS n, round(sum(loss), 4) AS loss FROM losses GROUP BY split, tw")
def losses_by_window_files(spark, d):
    """Losses written as a folder for each window and read again."""
    path = new_path(spark, "window-losses")
    reports.write_by_window(a.losses(spark, d), path)
    back = spark.read.option("header", True).schema("event_uuid long, t long, src long, dst long, op string, day int, loss double, split string, tw long").csv(path)
    return back.groupBy("split", "tw").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loss"), 4).alias("loss"))


NORMAL = GAPS + """, st AS (SELECT src, op, count(*) AS n, avg(gap) AS m, stddev_pop(gap) ** 2 AS v, stddev_samp(gap) AS s, min(gap) AS lo, max(gap) AS hi FROM gg GROUP BY src, op HAVING count(*) > 1 AND stddev_samp(gap) > 0),
h AS (SELECT *, n ** (-0.2::DOUBLE) * s AS h FROM st), a AS (SELECT *, lo - 3 * h AS a, (hi - lo + 6 * h) / 127 AS dx FROM h),
p AS (SELECT src, op, i, any_value(m) AS m, any_value(v) AS v, any_value(a) AS a, any_value(dx) AS dx, avg(exp(-0.5::DOUBLE * ((a + i * dx - gap) / h) ** 2) / (h * 2.5066282746310002::DOUBLE)) AS p FROM gg JOIN a USING (src, op), range(128) r(i) GROUP BY src, op, i),
q AS (SELECT src, op, dx, greatest(p, 1e-12::DOUBLE) AS p, greatest(exp(-0.5::DOUBLE * (a + i * dx - m) ** 2 / v) / sqrt(2 * 3.141592653589793::DOUBLE * v), 1e-12::DOUBLE) AS q FROM p)"""


@query(NORMAL + " SELECT src, op, round(sum(p * ln(p / q) * dx), 5) AS kl FROM q GROUP BY src, op")
def divergence_from_normal(spark, d):
    g = gap_seconds(spark, d)
    one = F.array(F.struct(F.avg("gap").alias("mean"), F.pow(F.stddev_pop("gap"), F.lit(2)).alias("var"), F.lit(1.0).alias("weight"))).alias("mixture")
    return vectors.divergence(g, g.groupBy("src", "op").agg(one), "gap", "src", "op").select("src", "op", F.round("kl", 5).alias("kl"))


@query(WITH + a.LOSSES + """, m AS (SELECT tw, avg(loss) AS m, stddev_pop(loss) AS s FROM losses GROUP BY tw) SELECT tw, CAST(k AS INTEGER) AS i, round(m + (k - 1) * sqrt(3::DOUBLE) * s, 5) AS x, round(CASE WHEN k = 1 THEN 2 / 3.0::DOUBLE ELSE 1 / 6.0::DOUBLE END, 6) AS weight FROM m, range(3) r(k)""")
def pseudo_points(spark, d):
    m = a.losses(spark, d).groupBy("tw").agg(F.array(F.struct(F.avg("loss").alias("mean"), F.pow(F.stddev_pop("loss"), F.lit(2)).alias("var"), F.lit(1.0).alias("weight"))).alias("mixture"))
    return m.select("tw", F.posexplode(vectors.pseudo_points("mixture")).alias("i", "p")).select("tw", "i", F.round("p.x", 5).alias("x"), F.round("p.weight", 6).alias("weight"))


# audit logs: the test tables written in a log's format and read back


def _record(version: int, kind: str, body) -> object:
    return F.concat(F.lit(f'{{"datum":{{"com.bbn.tc.schema.avro.cdm{version}.{kind}":{{'), *body, F.lit(f'}}}},"CDMVersion":"{version}"}}'))


def cdm_log(spark, d, version):
    """Lines of a log in the first or second format: a record for each node, then for each event. In the second one all values of flows are boxed, and some records lack a value."""
    e = a.prov(spark, d)
    n = a.nodes(e)
    uuid = lambda c: F.concat(F.lit("N-"), c)
    head = lambda c: [F.lit('"uuid":"'), uuid(c), F.lit('",')]
    box = (lambda kind, *x: [F.lit(f'{{"{kind}":'), *x, F.lit("}")]) if version > 18 else (lambda kind, *x: [*x])
    quote = lambda *x: [F.lit('"'), *x, F.lit('"')]
    subject = _record(version, "Subject", [*head("node_id"), F.lit('"cmdLine":{"string":"run '), F.col("label"), F.lit('"},"properties":{"map":{"path":"'), F.col("label"), F.lit('"}}')])
    file = _record(version, "FileObject", [*head("node_id"), F.lit('"baseObject":{"properties":{"map":{"filename":"'), F.col("label"), F.lit('"}}}')])
    flow = _record(version, "NetFlowObject", [*head("node_id"), F.lit('"localAddress":'), *box("string", *quote(F.lit("10.1.1.1"))), F.lit(',"localPort":'), *box("int", F.lit("80")), F.lit(',"remoteAddress":'), *box("string", *quote(F.col("label"))), F.lit(',"remotePort":'), *box("int", F.lit("443"))])
    nodes = n.select(F.when(F.col("node_type") == "subject", subject).when(F.col("node_type") == "file", file).otherwise(flow).alias("value"))
    partial = n.select(_record(version, "Subject", [F.lit('"uuid":"X-'), F.col("node_id"), F.lit('","cmdLine":null')]).alias("value"))
    back = F.col("op").isin(*a.REVERSED)
    s, o = F.when(back, F.col("dst")).otherwise(F.col("src")), F.when(back, F.col("src")).otherwise(F.col("dst"))
    ref = lambda name, c: [F.lit(f'"{name}":{{"com.bbn.tc.schema.avro.cdm{version}.UUID":"'), uuid(c), F.lit('"},')]
    event = _record(version, "Event", [F.lit('"uuid":"E-'), F.col("event_uuid"), F.lit('","type":"EVENT_'), F.col("op"), F.lit('",'), *ref("subject", s), *ref("predicateObject", o), F.lit('"timestampNanos":'), F.col("t"), F.lit(',"name":null')])
    path = new_path(spark, f"cdm{version}")
    nodes.union(e.select(event)).union(partial if version > 18 else partial.where("false")).write.text(path)
    return logs.lines(spark, path)


def cdm18_log(spark, d):
    return cdm_log(spark, d, 18)


CDM_NODES = WITH + a.PROV + ",\n" + a.NODES + " SELECT 'N-' || node_id AS node_uuid, node_type, CASE WHEN node_type = 'netflow' THEN NULL ELSE label END AS path, CASE WHEN node_type = 'subject' THEN 'run ' || label END AS cmd, CASE WHEN node_type = 'netflow' THEN label END AS dst_addr, CASE WHEN node_type = 'netflow' THEN '443' END AS dst_port, sha256('N-' || node_id) AS hash_id FROM nodes"
CDM_EVENTS = WITH + a.PROV + " SELECT 'N-' || src AS src, 'N-' || dst AS dst, 'EVENT_' || op AS op, 'E-' || event_uuid AS event_uuid, t FROM prov"


@query(CDM_NODES)
def cdm18_nodes(spark, d):
    return logs.cdm_nodes(cdm18_log(spark, d), 18).select("node_uuid", "node_type", "path", "cmd", "dst_addr", "dst_port", "hash_id")


@query(CDM_EVENTS)
def cdm18_events(spark, d):
    rows = cdm18_log(spark, d)
    nodes = logs.cdm_nodes(rows, 18)
    e = logs.cdm_events(rows, nodes, 18)
    ids = lambda c: nodes.select(F.col("node_id").alias(c), F.col("node_uuid").alias(c + "_uuid"))
    return e.join(ids("src"), "src").join(ids("dst"), "dst").select(F.col("src_uuid").alias("src"), F.col("dst_uuid").alias("dst"), "op", "event_uuid", "t")


@query(CDM_NODES)
def cdm20_nodes(spark, d):
    return logs.cdm_nodes(cdm_log(spark, d, 20), 20).select("node_uuid", "node_type", "path", "cmd", "dst_addr", "dst_port", "hash_id")


@query(CDM_EVENTS)
def cdm20_events(spark, d):
    rows = cdm_log(spark, d, 20)
    nodes = logs.cdm_nodes(rows, 20)
    e = logs.cdm_events(rows, nodes, 20)
    ids = lambda c: nodes.select(F.col("node_id").alias(c), F.col("node_uuid").alias(c + "_uuid"))
    return e.join(ids("src"), "src").join(ids("dst"), "dst").select(F.col("src_uuid").alias("src"), F.col("dst_uuid").alias("dst"), "op", "event_uuid", "t")


@query(WITH + a.PROV + ",\n" + a.NODES + " SELECT node_type, count(*) AS nodes, min(i) AS first, max(i) AS last FROM (SELECT node_type, row_number() OVER (ORDER BY CASE node_type WHEN 'netflow' THEN 0 WHEN 'subject' THEN 1 ELSE 2 END, node_id) - 1 AS i FROM nodes) GROUP BY node_type")
def dense_node_ids(spark, d):
    n = logs.cdm_nodes(cdm18_log(spark, d), 18)
    return n.groupBy("node_type").agg(F.count_distinct("node_id").alias("nodes"), F.min("node_id").alias("first"), F.max("node_id").alias("last"))


def host_log(spark, d):
    """Lines of a host log in the third format: an event a line between processes, files and flows."""
    e = typed_edges(spark, d)
    user = F.when(F.col("src_type") == "subject", F.col("src")).otherwise(F.col("dst"))
    thing = F.when(F.col("src_type") == "subject", F.col("dst")).otherwise(F.col("src"))
    kind = F.when(F.pmod(thing - a.OBJECTS, F.lit(3)) == 0, "FLOW").otherwise("FILE")
    props = F.when(kind == "FLOW", F.to_json(F.create_map(F.lit("image_path"), F.lit("/bin/x"), F.lit("src_ip"), F.lit("10.0.0.1"), F.lit("dest_port"), thing.cast("string"), F.lit("direction"), F.when(F.col("op") == "OPEN", "inbound").otherwise("outbound")))).otherwise(F.to_json(F.create_map(F.lit("image_path"), F.lit("/bin/x"), F.lit("file_path"), F.concat(F.lit("/f/"), thing))))
    action = F.when(F.col("op").isin("READ", "OPEN", "WRITE"), F.col("op")).otherwise("MESSAGE")
    line = F.concat(F.lit('{"action":"'), action, F.lit('","actorID":"P-'), user, F.lit('","hostname":"Host7.example.com","id":"E-'), F.col("event_uuid"), F.lit('","object":"'), kind, F.lit('","objectID":"O-'), thing, F.lit('","timestamp":"2019-09-23T10:11:12.345-04:00","properties":'), props, F.lit("}"))
    path = new_path(spark, "host-log")
    e.select(line.alias("value")).write.text(path)
    return logs.host_records(logs.lines(spark, path), "Host7")


@query(WITH + a.PROV + """, r AS (SELECT event_uuid, least(src, dst) AS u, greatest(src, dst) AS o, CASE WHEN op IN ('READ', 'OPEN', 'WRITE') THEN op ELSE 'MESSAGE' END AS act, op FROM prov)
SELECT 'E-' || event_uuid AS event_uuid, act AS op, CASE WHEN act = 'READ' OR ((o - 1000000) % 3 = 0 AND op = 'OPEN') THEN 'O-' || o ELSE 'P-' || u END AS src, CASE WHEN act = 'READ' OR ((o - 1000000) % 3 = 0 AND op = 'OPEN') THEN 'P-' || u ELSE 'O-' || o END AS dst FROM r""")
def host_log_events(spark, d):
    rows = host_log(spark, d)
    nodes = logs.host_nodes(rows)
    e = logs.host_events(rows, nodes)
    ids = lambda c: nodes.select(F.col("node_id").alias(c), F.col("node_uuid").alias(c + "_uuid"))
    return e.join(ids("src"), "src").join(ids("dst"), "dst").select("event_uuid", "op", F.col("src_uuid").alias("src"), F.col("dst_uuid").alias("dst"))


@query(WITH + a.PROV + ",\n" + a.NODES + """, e AS (SELECT event_uuid, t, op, CASE WHEN src < 1000000 THEN src ELSE dst END AS pid, CASE WHEN src < 1000000 THEN dst ELSE src END AS object FROM prov),
r AS MATERIALIZED (SELECT e.*, CASE WHEN node_type = 'file' AND op = 'OPEN' THEN 'open' WHEN node_type = 'file' AND op IN ('READ', 'WRITE') THEN lower(op) WHEN node_type = 'netflow' AND op IN ('CONNECT', 'RECVFROM') THEN 'socket' END AS action FROM e JOIN nodes ON node_id = object),
k AS (SELECT *, action = 'open' OR row_number() OVER (PARTITION BY pid, object ORDER BY t, event_uuid) = 1 AS taken FROM r WHERE action IS NOT NULL), c AS (SELECT *, sum(CAST(taken AS INTEGER)) OVER (PARTITION BY pid ORDER BY t, event_uuid) AS made FROM k),
f AS (SELECT *, max(CASE WHEN taken THEN made + 2 END) OVER (PARTITION BY pid, object ORDER BY t, event_uuid) AS fd FROM c)
SELECT event_uuid, 'converted' AS outcome, action, CASE op WHEN 'OPEN' THEN 2 WHEN 'READ' THEN 0 WHEN 'WRITE' THEN 1 WHEN 'CONNECT' THEN 42 ELSE 45 END AS syscall, pid, object, CAST(fd AS BIGINT) AS fd, taken AND action <> 'open' AS opened, CAST(0 AS BIGINT) AS ppid FROM f
UNION ALL SELECT event_uuid, 'skipped', 'none', -1, -1, -1, -1, false, -1 FROM r WHERE action IS NULL""")
def system_calls(spark, d):
    e = a.prov(spark, d)
    kinds = a.nodes(e).select(F.col("node_id").alias("node"), F.col("node_type").alias("kind"))
    calls = audit_trail.system_calls(e.withColumn("op", F.concat(F.lit("EVENT_"), "op")), kinds)
    return calls.na.fill(-1, ["syscall", "pid", "object", "fd", "ppid"]).na.fill(False, ["opened"]).na.fill("none", ["action"])

"""Queries over random walks, random pairs and what nodes remember as of a batch; draws are digests, so SQL draws alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import memory, walking
from tracewell.plans.catalogue import WITH, query
from tracewell.sources import adapters as a


def drawn_sql(seed: int, *of: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || " + " || '|' || ".join(of) + "), 1, 15))::BIGINT"


def walk_sql(name: str, edges: str, length: int, per_node: int, temporal: bool, starts: str = "") -> str:
    """Expressions o, p, w0, w1 ... of edges (node, next, op, e_t, event_uuid), their names ended by ``name``."""
    o, p, w = f"o_{name}", f"p_{name}", f"w_{name}"
    parts = [
        f"{o} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node ORDER BY e_t, event_uuid) AS r, count(*) OVER (PARTITION BY node) AS deg FROM {edges})",
        f"{p} AS MATERIALIZED (SELECT node, e_t, max(r) AS seen, max(deg) AS deg FROM {o} GROUP BY node, e_t)",
        f"{w}0 AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS walk, node AS start, 0 AS step, node, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS t FROM (SELECT DISTINCT node FROM {o}), range({per_node}) v(i) {starts})",
    ]
    for k in range(1, length):
        seen = f"coalesce((SELECT max(p.seen) FROM {p} p WHERE p.node = w.node AND p.e_t <= w.t), 0)" if temporal else "0"
        parts.append(
            f"{w}{k} AS MATERIALIZED (SELECT walk, start, {k} AS step, o.next AS node, o.op, o.e_t AS t FROM (SELECT w.walk, w.start, w.node, d.deg, {seen} AS seen FROM {w}{k - 1} w JOIN (SELECT DISTINCT node, deg FROM {o}) d ON d.node = w.node) x "
            f"JOIN {o} o ON o.node = x.node AND o.r = x.seen + 1 + {drawn_sql(0, 'start', 'walk', str(k))} % greatest(x.deg - x.seen, 1) WHERE x.deg > x.seen)"
        )
    return ", ".join(parts)


def steps_sql(name: str, length: int, step: str = "step") -> str:
    return " UNION ALL ".join(f"SELECT walk, start, {step} AS step, node, op FROM w_{name}{k}" for k in range(length))


FORTH = ", f AS (SELECT src AS node, dst AS next, op, t AS e_t, event_uuid FROM prov)"
BACK = ", b AS (SELECT dst AS node, src AS next, op, -t AS e_t, event_uuid FROM prov)"


@query(WITH + a.PROV + FORTH + ", " + walk_sql("f", "f", 4, 2, False) + " " + steps_sql("f", 4))
def hash_walks(spark, d):
    return walking.walks(a.prov(spark, d), 4, 2)


@query(WITH + a.PROV + FORTH + BACK + ", " + walk_sql("f", "f", 4, 2, True) + ", " + walk_sql("b", "b", 4, 2, True, "WHERE node NOT IN (SELECT src FROM prov)") + " " + steps_sql("f", 4) + " UNION ALL " + steps_sql("b", 4, "-step"))
def temporal_walks(spark, d):
    return walking.temporal_walks(a.prov(spark, d), 4, 2)


def degree_sql(src: str, dst: str) -> str:
    return WITH + a.PROV + f""", pairs AS (SELECT {src} AS node, {dst} AS next, list_sort(list(DISTINCT op)) AS ops FROM prov GROUP BY ALL), near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node ORDER BY next) - 1 AS k, count(*) OVER (PARTITION BY node) AS deg FROM pairs),
dg AS MATERIALIZED (SELECT DISTINCT node, deg FROM near), w(start, walk, step, node, op) AS (SELECT node, 2 * k + i, 0, node, CAST(NULL AS VARCHAR) FROM near, range(2) v(i)
UNION ALL SELECT w.start, w.walk, w.step + 1, n.next, n.ops[1 + {drawn_sql(1, 'w.start', 'w.walk', '(w.step + 1)')} % len(n.ops)] FROM w JOIN dg ON dg.node = w.node JOIN near n ON n.node = w.node AND n.k = {drawn_sql(0, 'w.start', 'w.walk', '(w.step + 1)')} % dg.deg WHERE w.step < 4)
SELECT start, walk, step, node, op FROM w"""


@query(degree_sql("src", "dst"))
def degree_walks(spark, d):
    return walking.degree_walks(a.prov(spark, d), 4, 2)


@query(degree_sql("dst", "src"))
def degree_walks_back(spark, d):
    return walking.degree_walks(walking.reversed_edges(a.prov(spark, d)), 4, 2)


@query(WITH + a.PROV + """, pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM prov), x AS (SELECT src, row_number() OVER (ORDER BY md5('1|' || src || '|' || dst), src, dst) AS r FROM pairs), y AS (SELECT dst, row_number() OVER (ORDER BY md5('2|' || src || '|' || dst), src, dst) AS r FROM pairs)
SELECT DISTINCT src, dst FROM x JOIN y USING (r) WHERE src <> dst EXCEPT SELECT src, dst FROM pairs""")
def negative_pairs(spark, d):
    return walking.negatives(a.prov(spark, d))


def six_hours(spark, d):
    """Events in batches of six hours."""
    return a.prov(spark, d).withColumn("batch", F.floor(F.col("t") / (6 * a.HOUR)))


ENDS = WITH + a.PROV + ", x AS (SELECT *, t // 21600000000000 AS batch FROM prov), ends AS MATERIALIZED (SELECT batch, t, event_uuid, value, src AS node, dst AS neighbour, true AS sent FROM x UNION ALL SELECT batch, t, event_uuid, value, dst, src, false FROM x)"


def hop_sql(before: str) -> str:
    last = "SELECT batch, {h} AS hop, node, neighbour, e_id FROM (SELECT a.batch, a.node, e.neighbour, e.event_uuid AS e_id, row_number() OVER (PARTITION BY a.batch, a.node ORDER BY e.batch DESC, e.t DESC, e.event_uuid DESC, e.neighbour DESC) AS r FROM {a} a JOIN ends e ON e.node = a.node AND e.batch " + before + " a.batch) WHERE r <= 3"
    return ENDS + f", a1 AS MATERIALIZED (SELECT DISTINCT batch, node FROM ends), h1 AS MATERIALIZED ({last.format(h=1, a='a1')}), a2 AS MATERIALIZED (SELECT batch, neighbour AS node FROM h1 EXCEPT SELECT batch, node FROM a1), h2 AS ({last.format(h=2, a='a2')}) SELECT * FROM h1 UNION ALL SELECT * FROM h2"


@query(hop_sql("<"))
def hop_neighbours(spark, d):
    return memory.hop_neighbours(six_hours(spark, d), 3, 2)


@query(hop_sql("<="))
def hop_neighbours_inserted(spark, d):
    return memory.hop_neighbours(six_hours(spark, d), 3, 2, with_batch=True)


STORE = "(SELECT s.batch, s.node, e.n, e.mean, e.x, e.t FROM asked s ASOF JOIN (SELECT * FROM store WHERE sent = {sent}) e ON e.node = s.node AND e.batch < s.batch)"


@query(ENDS + f""", store AS MATERIALIZED (SELECT batch, node, sent, count(*) AS n, avg(value) AS mean, arg_max(value, (t, event_uuid)) AS x, max(t) AS t FROM ends GROUP BY ALL), asked AS MATERIALIZED (SELECT DISTINCT batch, node FROM ends)
SELECT batch, node, greatest(s.t, g.t) AS last_update, coalesce(s.n, 0) AS sent_n, round(s.mean, 6) AS sent_mean, s.x AS sent_last, coalesce(g.n, 0) AS got_n, round(g.mean, 6) AS got_mean, g.x AS got_last
FROM asked LEFT JOIN {STORE.format(sent='true')} s USING (batch, node) LEFT JOIN {STORE.format(sent='false')} g USING (batch, node)""")
def node_messages(spark, d):
    found = memory.stored_messages(six_hours(spark, d), "value")
    return found.withColumns({c: F.round(c, 6) for c in ("sent_mean", "got_mean")})

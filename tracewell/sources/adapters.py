"""The driver's tables as provenance data: events between users and objects, their nodes, splits, losses and attacks.

Each view has its twin as a SQL common table expression, so that queries and the SQL they are held against start alike.
Times are epoch nanoseconds in longs throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000
OBJECTS = 1_000_000
OPS = {"view": "READ", "click": "OPEN", "purchase": "WRITE", "signup": "CONNECT", "error": "RECVFROM"}
REVERSED = ("READ", "OPEN", "RECVFROM")
ATTACK_NODES = [(0, 3), (0, 17), (0, OBJECTS + 5), (1, 17), (1, 42), (2, 60), (2, OBJECTS + 33)]
#: attack, first and last day of the month, inclusive
ATTACK_DAYS = [(0, 24, 25), (1, 26, 26), (2, 27, 29)]
EPOCH_DAY = 19723  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_uuid, t, src, dst, op, day, value): operations that read flow from the object to the user."""
    e = table(spark, sf_dir, "events")
    op = F.element_at(F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv]), F.col("event_type"))
    t = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    rows = e.select(F.col("event_id").alias("event_uuid"), t.alias("t"), F.col("user_id").alias("u"), (OBJECTS + F.get_json_object("props", "$.k").cast("long")).alias("o"), op.alias("op"), "value")
    back = F.col("op").isin(*REVERSED)
    return rows.select("event_uuid", "t", F.when(back, F.col("o")).otherwise(F.col("u")).alias("src"), F.when(back, F.col("u")).otherwise(F.col("o")).alias("dst"), "op", (F.floor(F.col("t") / DAY) - EPOCH_DAY + 1).cast("int").alias("day"), "value")


PROV = """prov AS (SELECT event_id AS event_uuid, t, CASE WHEN op IN ('READ', 'OPEN', 'RECVFROM') THEN o ELSE u END AS src, CASE WHEN op IN ('READ', 'OPEN', 'RECVFROM') THEN u ELSE o END AS dst, op,
  CAST(t // 86400000000000 - 19723 + 1 AS INTEGER) AS day, value FROM (SELECT event_id, epoch_ns(ts) AS t, user_id AS u, 1000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS o, value,
  CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'OPEN' WHEN 'purchase' THEN 'WRITE' WHEN 'signup' THEN 'CONNECT' ELSE 'RECVFROM' END AS op FROM events))"""


def split_of(day) -> object:
    return F.when(day <= 18, "train").when(day <= 22, "val").otherwise("test")


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prov with loss, window number tw (six hours) and split."""
    return prov(spark, sf_dir).select("event_uuid", "t", "src", "dst", "op", "day", F.col("value").alias("loss"), F.floor(F.col("t") / (6 * HOUR)).alias("tw"), split_of(F.col("day")).alias("split"))


LOSSES = PROV + """,
losses AS (SELECT event_uuid, t, src, dst, op, day, value AS loss, t // 21600000000000 AS tw, CASE WHEN day <= 18 THEN 'train' WHEN day <= 22 THEN 'val' ELSE 'test' END AS split FROM prov)"""


def nodes(events: DataFrame) -> DataFrame:
    """(node_id, node_type, label) of all nodes of events: users are subjects, objects are netflows or files."""
    ids = events.select(F.col("src").alias("node_id")).union(events.select("dst")).distinct()
    k = F.col("node_id") - OBJECTS
    kind = F.when(k < 0, "subject").when(k % 3 == 0, "netflow").otherwise("file")
    label = F.when(k < 0, F.concat(F.lit("/u/"), "node_id")).when(k % 3 == 0, F.concat(F.lit("10.0."), k % 7, F.lit("."), k)).otherwise(F.concat(F.lit("/f/"), k % 10, F.lit("/"), k))
    return ids.select("node_id", kind.alias("node_type"), label.alias("label"))


NODES = """nodes AS (SELECT node_id, CASE WHEN k < 0 THEN 'subject' WHEN k % 3 = 0 THEN 'netflow' ELSE 'file' END AS node_type,
  CASE WHEN k < 0 THEN '/u/' || node_id WHEN k % 3 = 0 THEN '10.0.' || (k % 7) || '.' || k ELSE '/f/' || (k % 10) || '/' || k END AS label
  FROM (SELECT node_id, node_id - 1000000 AS k FROM (SELECT src AS node_id FROM prov UNION SELECT dst FROM prov)))"""


def attack_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ATTACK_NODES, "attack_id int, node_id long")


def attacks(spark: SparkSession) -> DataFrame:
    rows = [(a, (EPOCH_DAY + first - 1) * DAY, (EPOCH_DAY + last) * DAY - 1) for a, first, last in ATTACK_DAYS]
    return spark.createDataFrame(rows, "attack_id int, start_ns long, end_ns long")


ATTACKS = (
    "attack_nodes(attack_id, node_id) AS (VALUES " + ", ".join(f"(CAST({a} AS INTEGER), CAST({n} AS BIGINT))" for a, n in ATTACK_NODES) + "),\nattacks(attack_id, start_ns, end_ns) AS (VALUES "
    + ", ".join(f"(CAST({a} AS INTEGER), CAST({(EPOCH_DAY + f - 1) * DAY} AS BIGINT), CAST({(EPOCH_DAY + l) * DAY - 1} AS BIGINT))" for a, f, l in ATTACK_DAYS) + ")"
)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a temporal multigraph: (src, dst, op, t, event_uuid)."""
    t = F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50 + OBJECTS).alias("dst"), F.col("l_returnflag").alias("op"), t.alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_uuid"))


TRADE = "trade AS (SELECT l_suppkey AS src, l_partkey % 50 + 1000000 AS dst, l_returnflag AS op, epoch_ns(l_shipdate) AS t, l_orderkey * 8 + l_linenumber AS event_uuid FROM lineitem)"

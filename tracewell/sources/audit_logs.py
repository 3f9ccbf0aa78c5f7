"""Host audit logs in three formats as node and event tables.

Lines stay in JVM expressions: JSON paths or patterns, no Python. ``seq`` keeps the order of lines (input partition, then line), so that
the last record of a uuid wins, as in one pass over the files. Dense ids are numbered in two levels: rows are ranked within their
input partition, and the partitions' totals, one row each, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.times import from_gmt_minus_4

# Operations that flow from object to subject, operations left out, operations kept of the third format.
REVERSED = ["EVENT_EXECUTE", "EVENT_LSEEK", "EVENT_MMAP", "EVENT_OPEN", "EVENT_ACCEPT", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG", "EVENT_READ_SOCKET_PARAMS", "EVENT_CHECK_FILE_ATTRIBUTES", "READ"]
EXCLUDED = ["EVENT_FCNTL", "EVENT_OTHER", "EVENT_ADD_OBJECT_ATTRIBUTE", "EVENT_FLOWS_TO"]
HOST_ACTIONS = ["OPEN", "READ", "CREATE", "MESSAGE", "MODIFY", "START", "RENAME", "DELETE", "TERMINATE", "WRITE"]

NODE = ("node_uuid", "hash_id", "path", "cmd", "src_addr", "src_port", "dst_addr", "dst_port")


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths)).withColumn("seq", F.monotonically_increasing_id())


def union_field(name: str, base: str, kind: str = "string") -> Column:
    """A JSON field that is a scalar or an object {kind: scalar}; the text null if it has neither."""
    boxed, plain = F.get_json_object("value", f"$.{base}.{name}.{kind}"), F.get_json_object("value", f"$.{base}.{name}")
    return F.coalesce(boxed, F.when(~F.coalesce(plain, F.lit("")).startswith("{"), plain), F.lit("null"))


def last_of(rows: DataFrame) -> DataFrame:
    """One row per uuid: the last line's attributes, the first line's place."""
    attrs = [c for c in rows.columns if c not in ("node_uuid", "seq")]
    best = rows.groupBy("node_uuid").agg(F.max_by(F.struct(*attrs), "seq").alias("last"), F.min("seq").alias("seq"))
    return best.select("node_uuid", F.sha2("node_uuid", 256).alias("hash_id"), "last.*", "seq")


def _records(rows: DataFrame, kind: str, version: int, **attributes) -> DataFrame:
    """(node_uuid, attributes, seq) of the lines that hold a record of a kind. An attribute is a function of the record's JSON path. In the later version a record that lacks one is left out; in the earlier one that attribute is the text null."""
    name = f"com.bbn.tc.schema.avro.cdm{version}.{kind}"
    base = f"datum['{name}']"
    found = rows.where(F.col("value").contains(f'{{"datum":{{"{name}"')).select(F.get_json_object("value", f"$.{base}.uuid").alias("node_uuid"), *(f(base).alias(c) for c, f in attributes.items()), "seq")
    if version > 18:
        for c in attributes:
            found = found.where(F.col(c) != "null")
    return last_of(found.where("node_uuid IS NOT NULL"))


def _first_of(*paths: str):
    return lambda base: F.coalesce(*(F.get_json_object("value", f"$.{base}.{x}") for x in paths), F.lit("null"))


def _field(name: str, kind: str = "string"):
    return lambda base: union_field(name, base, kind)


def cdm_netflows(rows: DataFrame, version: int) -> DataFrame:
    return _records(rows, "NetFlowObject", version, src_addr=_field("localAddress"), src_port=_field("localPort", "int"), dst_addr=_field("remoteAddress"), dst_port=_field("remotePort", "int"))


def cdm_subjects(rows: DataFrame, version: int) -> DataFrame:
    return _records(rows, "Subject", version, path=_first_of("properties.map.path"), cmd=_field("cmdLine"))


def cdm_files(rows: DataFrame, version: int) -> DataFrame:
    """Properties go before the base object's own fields, file names before paths."""
    paths = ("properties.map.filename", "properties.map.path", "filename", "path") if version == 18 else ("properties.map.filename", "filename")
    return _records(rows, "FileObject", version, path=_first_of(*(f"baseObject.{x}" for x in paths)))


def dense_ids(kinds: list[tuple[str, DataFrame]]) -> DataFrame:
    """All nodes in one table with node_type and node_id: kinds in the order given, nodes in the order of their first lines."""
    parts = []
    for i, (kind, rows) in enumerate(kinds):
        have = set(rows.columns)
        parts.append(rows.select(F.lit(kind).alias("node_type"), F.lit(i).alias("rank"), *((F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in NODE), "seq"))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    nodes = nodes.withColumn("part", F.shiftright("seq", 33))
    totals = nodes.groupBy("rank", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(W.orderBy("rank", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("rank", "part").orderBy("seq", "node_uuid")) - 1
    return nodes.join(F.broadcast(totals.select("rank", "part", offset.alias("offset"))), ["rank", "part"]).withColumn("node_id", F.col("offset") + place).select("node_id", "node_type", *NODE)


def cdm_nodes(rows: DataFrame, version: int) -> DataFrame:
    return dense_ids([("netflow", cdm_netflows(rows, version)), ("subject", cdm_subjects(rows, version)), ("file", cdm_files(rows, version))])


def cdm_events(rows: DataFrame, nodes: DataFrame, version: int) -> DataFrame:
    """(src, dst, op, event_uuid, t): events whose subject and object are known nodes; an object uuid is looked up as a file, then a netflow, then a subject. Reversed operations flow from the object."""
    mark = f"com.bbn.tc.schema.avro.cdm{version}"
    at = {"op": r'"type":"(.*?)"', "subject": rf'"subject":\{{"{mark}\.UUID":"(.*?)"', "object": rf'"predicateObject":\{{"{mark}\.UUID":"(.*?)"', "event_uuid": rf'\{{"datum":\{{"{mark}\.Event":\{{"uuid":"(.*?)",', "t": r'"timestampNanos":(.*?),'}
    raw = rows.where(F.col("value").contains(f'{{"datum":{{"{mark}.Event"')).select(*(F.regexp_extract("value", p, 1).alias(c) for c, p in at.items()))
    raw = raw.where(~F.col("op").isin(EXCLUDED) & (F.col("subject") != "") & (F.col("object") != "")).withColumn("t", F.col("t").cast("long"))
    order = F.when(F.col("node_type") == "file", 0).when(F.col("node_type") == "netflow", 1).otherwise(2)
    objects = nodes.groupBy(F.col("node_uuid").alias("object")).agg(F.min_by("node_id", order).alias("o"))
    subjects = nodes.where("node_type = 'subject'").select(F.col("node_uuid").alias("subject"), F.col("node_id").alias("s"))
    known = raw.join(subjects, "subject").join(objects, "object")
    back = F.col("op").isin(REVERSED)
    return known.select(F.when(back, F.col("o")).otherwise(F.col("s")).alias("src"), F.when(back, F.col("s")).otherwise(F.col("o")).alias("dst"), "op", "event_uuid", "t")


HOST_EVENT = "action string, actorID string, hostname string, id string, object string, objectID string, timestamp string, properties map<string,string>"


def host_records(rows: DataFrame, host: str) -> DataFrame:
    """Records of one host, of the actions kept; double back slashes count as slashes."""
    text = F.replace("value", F.lit("\\\\"), F.lit("/"))
    return rows.select("seq", F.from_json(text, HOST_EVENT).alias("r")).select("seq", "r.*").where((F.substring_index("hostname", ".", 1) == host) & F.col("action").isin(HOST_ACTIONS))


def host_nodes(records: DataFrame) -> DataFrame:
    """Actors and process objects are subjects (an object record of a line comes after its actor record), then files, then flows."""
    r = records.where(F.col("object").isin("FILE", "FLOW", "PROCESS"))
    p = lambda k: F.try_element_at("properties", F.lit(k))
    actors = r.select(F.col("actorID").alias("node_uuid"), p("image_path").alias("path"), F.lit(None).cast("string").alias("cmd"), (F.col("seq") * 2).alias("seq"))
    processes = r.where("object = 'PROCESS'").select(F.col("objectID").alias("node_uuid"), p("parent_image_path").alias("path"), p("command_line").alias("cmd"), (F.col("seq") * 2 + 1).alias("seq"))
    files = r.where("object = 'FILE'").select(F.col("objectID").alias("node_uuid"), p("file_path").alias("path"), "seq")
    flows = r.where("object = 'FLOW'").select(F.col("objectID").alias("node_uuid"), p("src_ip").alias("src_addr"), p("src_port").alias("src_port"), p("dest_ip").alias("dst_addr"), p("dest_port").alias("dst_port"), "seq")
    return dense_ids([("subject", last_of(actors.unionByName(processes)).withColumn("seq", F.shiftright("seq", 1))), ("file", last_of(files)), ("netflow", last_of(flows))])


def host_events(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reads and inbound flows are reversed; both ends must be known."""
    ids = nodes.groupBy("node_uuid").agg(F.max("node_id").alias("node_id"))
    both = records.join(ids.select(F.col("node_uuid").alias("actorID"), F.col("node_id").alias("s")), "actorID").join(ids.select(F.col("node_uuid").alias("objectID"), F.col("node_id").alias("o")), "objectID")
    inbound = (F.col("object") == "FLOW") & (F.coalesce(F.try_element_at("properties", F.lit("direction")), F.lit("")) == "inbound")
    back = (F.col("action") == "READ") | inbound
    return both.select(F.when(back, F.col("o")).otherwise(F.col("s")).alias("src"), F.when(back, F.col("s")).otherwise(F.col("o")).alias("dst"), F.col("action").alias("op"), F.col("id").alias("event_uuid"), from_gmt_minus_4(F.col("timestamp")).alias("t"))


# smaller sources


def ground_truth(spark: SparkSession, *paths: str) -> DataFrame:
    """Header-less (node_uuid, label, index_id); labels are quoted dictionaries."""
    return spark.read.schema("node_uuid string, label string, index_id string").csv(list(paths), quote='"', escape='"').withColumn("index_id", F.trim("index_id").cast("long"))


def keep_attacks(spark: SparkSession, path: str, nodes: DataFrame, out: str) -> DataFrame:
    """Rows labelled attack of a five-column file, joined to node ids, written to a new table."""
    raw = spark.read.schema("node_uuid string, label string, c string, d string, e string").csv(path, quote='"', escape='"')
    kept = raw.where("label = 'attack'").join(nodes.select("node_uuid", "node_id"), "node_uuid").select("node_uuid", "label", "node_id")
    kept.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def merged_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Merged-edge files with a header, all text; rows that don't fit are dropped. Optional type columns stay if they are there."""
    return spark.read.csv(list(paths), header=True, mode="DROPMALFORMED")


def flow_pairs(rows: DataFrame, src: int, dst: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst) from text with columns at 1-based places between white space, and the number of short rows."""
    parts = F.split(F.trim("value"), r"\s+")
    fit = F.size(parts) >= max(src, dst)
    good = rows.where(fit).select(F.get(parts, src - 1).alias("src"), F.get(parts, dst - 1).alias("dst"))
    return good, rows.agg(F.count_if(~fit).alias("malformed"))


def batch_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing files of either generation (``results`` or ``detailed_results``) as rows."""
    raw = spark.read.option("multiLine", True).json(path)
    have = [c for c in ("results", "detailed_results") if c in raw.columns]
    out = None
    for c in have:
        part = raw.where(F.col(c).isNotNull()).select(F.explode(c).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def jdbc_events(spark: SparkSession, url: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """The event table over JDBC in ranges of time, so the database is read in parallel."""
    return spark.read.jdbc(url, "event_table", column="timestamp_rec", lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)


def write_tables(nodes: DataFrame, events: DataFrame, folder: str) -> None:
    """Nodes, and events by day: the tables that windows are cut from."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    day = F.floor(F.col("t") / 86_400_000_000_000)
    events.withColumn("day", day).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{folder}/events")

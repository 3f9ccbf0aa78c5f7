"""Events as system calls: a rule for each operation and pair of node kinds, and the descriptors that each process holds.

Which descriptor an event uses depends on what its process did before; all of it comes from running sums and extremes in two levels (``operators.running``), so a process with a
third of all events is no task of its own, and nothing is folded in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.running import numbered, running
from tracewell.operators.storage import bounded, written

# Operation, end of the process, kind of the other end, action, number of the system call.
RULES = [
    ("EVENT_CLONE", "src", "subject", "clone", 59), ("EVENT_OPEN", "dst", "file", "open", 2), ("EVENT_EXECUTE", "dst", "file", "open", 2), ("EVENT_READ", "dst", "file", "read", 0), ("EVENT_WRITE", "src", "file", "write", 1),
    ("EVENT_UNLINK", "src", "file", "unlink", 87), ("EVENT_UNLINKAT", "src", "file", "unlink", 263),
    *((op, end, "netflow", "socket", n) for op, n in (("EVENT_CONNECT", 42), ("EVENT_ACCEPT", 43), ("EVENT_SENDTO", 44), ("EVENT_SENDMSG", 44), ("EVENT_RECVFROM", 45), ("EVENT_RECVMSG", 45)) for end in ("src", "dst")),
    ("EVENT_CLOSE", "src", "file", "close", 3), ("EVENT_CLOSE", "dst", "file", "close", 3),
]
FIRST = 3


def rules(spark: SparkSession) -> DataFrame:
    """(op, src_kind, dst_kind, end, action, syscall): no two rules fit the same operation and kinds."""
    return spark.createDataFrame([(op, *(("subject", kind) if end == "src" else (kind, "subject")), end, action, n) for op, end, kind, action, n in RULES], "op string, src_kind string, dst_kind string, end string, action string, syscall int")


def system_calls(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(event_uuid, outcome, action, syscall, pid, object, fd, opened, ppid) for each edge (event_uuid, t, src, dst, op); kinds has (node, kind).

    Events without a rule are ``skipped``. Opening takes the process's next descriptor, from 3 on; reading, writing and using a socket take the one held for the object, or the next one if there is none (``opened``, for files an opening that the
    log lacks). Closing gives it back, and is ``missing`` without one; numbers are not used again. ppid is the process that last cloned pid before, else 0. Order is t, then event_uuid; nodes without a kind have no rule.
    """
    ends = bounded(written(kinds.select("node", "kind"), "kinds"))
    rows = edges.join(ends.select(F.col("node").alias("src"), F.col("kind").alias("src_kind")), "src", "left").join(ends.select(F.col("node").alias("dst"), F.col("kind").alias("dst_kind")), "dst", "left")
    rows = rows.join(F.broadcast(rules(edges.sparkSession)), ["op", "src_kind", "dst_kind"], "left")
    own = F.col("end") == "src"
    rows = written(rows.select("event_uuid", "t", "op", "action", "syscall", F.when(own, F.col("src")).otherwise(F.col("dst")).alias("pid"), F.when(own, F.col("dst")).otherwise(F.col("src")).alias("object")), "ruled")
    known = numbered(rows.where("action IS NOT NULL"), ["pid"], ["t", "event_uuid"], "pos")
    holds = F.col("action").isin("open", "read", "write", "socket", "close")
    state = running(known, ["pid", "object"], ["pos"], "max", True, last=F.when(holds, F.col("pos") * 2 + (F.col("action") == "close").cast("int")))
    state = state.withColumn("held", F.coalesce(F.col("last") % 2 == 0, F.lit(False)))
    taken = (F.col("action") == "open") | (F.col("action").isin("read", "write", "socket") & ~F.col("held"))
    state = running(state.withColumn("taken", taken), ["pid"], ["pos"], made=F.col("taken").cast("long"))
    state = running(state, ["pid", "object"], ["pos"], "max", fd=F.when(F.col("taken"), F.col("made") + FIRST - 1))
    event = state.select("event_uuid", "t", "action", "syscall", "pid", "object", F.when(holds, F.col("fd")).alias("fd"), (F.col("taken") & (F.col("action") != "open")).alias("opened"), "held", F.lit(1).alias("own"))
    none = {c: F.lit(None).cast(event.schema[c].dataType).alias(c) for c in ("action", "syscall", "object", "fd", "opened", "held")}
    cloned = rows.where("action = 'clone'").select("event_uuid", "t", F.col("object").alias("pid"), F.col("pid").alias("parent"))
    both = event.withColumn("parent", F.lit(None).cast(event.schema["pid"].dataType)).unionByName(cloned.select("event_uuid", "t", "pid", "parent", F.lit(2).alias("own"), *none.values()))
    last = F.when(F.col("parent").isNotNull(), F.struct("t", "event_uuid", "parent"))
    both = running(both, ["pid"], ["t", "event_uuid", "own"], "max", True, cloned=last).where("own = 1")
    missing = (F.col("action") == "close") & ~F.col("held")
    done = both.select("event_uuid", F.when(missing, "missing").otherwise("converted").alias("outcome"), "action", "syscall", "pid", "object", F.when(~missing, F.col("fd")).alias("fd"), "opened", F.coalesce(F.col("cloned.parent"), F.lit(0)).alias("ppid"))
    rest = rows.where("action IS NULL").select("event_uuid", F.lit("skipped").alias("outcome"), *(F.lit(None).cast(done.schema[c].dataType).alias(c) for c in done.columns[2:]))
    return done.unionByName(rest)

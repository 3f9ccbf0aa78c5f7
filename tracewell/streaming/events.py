"""Streams of events: windows, repeats, last neighbours. Times of the stream are timestamps; ns stay in column t."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """events with a watermark on ts, made from t, and without repeats of an event_uuid within it."""
    return events.withColumn("ts", F.timestamp_micros(F.floor(F.col("t") / 1000))).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_uuid"])


def window_losses(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Count and largest loss per tumbling or sliding window."""
    return events.groupBy(F.window("ts", size, slide or size)).agg(F.count(F.lit(1)).alias("n"), F.max("loss").alias("score")).select("window.start", "window.end", "n", "score")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Count per source and session of events less than ``gap`` apart."""
    return events.groupBy("src", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("src", "s.start", "s.end", "n")


def last_neighbours(events: DataFrame, size: int) -> DataFrame:
    """After each batch, for each node in it: its last ``size`` neighbours, oldest first. State is a ring per node."""
    ends = events.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"), "t", "event_uuid").select("e.*", "t", "event_uuid")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (ring,) = state.get if state.exists else ([],)
        rows = pd.concat(list(parts)).sort_values(["t", "event_uuid"])
        ring = [*ring, *(int(x) for x in rows["other"])][-size:]
        state.update((ring,))
        yield pd.DataFrame({"node": [key[0]], "neighbours": [ring]})

    return ends.groupBy("node").applyInPandasWithState(update, "node long, neighbours array<long>", "ring array<long>", "update", GroupStateTimeout.NoTimeout)


def message_stores(events: DataFrame, value: str) -> DataFrame:
    """For each node of a micro-batch what it finds in its message stores, as ``memory.stored_messages`` has it for written batches: (node, last_update, sent_n, sent_mean, sent_last, got_n, got_mean, got_last).

    A store is overwritten by the next micro-batch in which the node sends (or gets) anything. State is number, mean, last value and last time of both, so a hub's messages are
    folded part by part and never kept. Edges with a null end are left out.
    """
    end = lambda a, sent: F.struct(F.col(a).alias("node"), F.lit(sent).alias("sent"))
    known = events.where("src IS NOT NULL AND dst IS NOT NULL")
    ends = known.select(F.explode(F.array(end("src", True), end("dst", False))).alias("e"), "t", "event_uuid", F.col(value).cast("double").alias("x")).select("e.*", "t", "event_uuid", "x")
    names = ["node", "last_update", "sent_n", "sent_mean", "sent_last", "got_n", "got_mean", "got_last"]

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [0, None, None, None] * 2
        times = [t for t in (held[3], held[7]) if t is not None]
        row = [key[0], max(times, default=None), *held[:3], *held[4:7]]
        counts, sums, valued, last = [0, 0], [0.0, 0.0], [0, 0], [None, None]
        for part in parts:
            for sent, rows in part.groupby("sent"):
                i = 0 if sent else 1
                counts[i], sums[i], valued[i] = counts[i] + len(rows), sums[i] + float(rows["x"].sum()), valued[i] + int(rows["x"].notna().sum())
                final = rows.sort_values(["t", "event_uuid"]).iloc[-1]
                latest = (int(final["t"]), int(final["event_uuid"]), None if pd.isna(final["x"]) else float(final["x"]))
                last[i] = latest if last[i] is None or latest[:2] > last[i][:2] else last[i]
        for i in range(2):
            if counts[i]:
                held[4 * i : 4 * i + 4] = [counts[i], sums[i] / valued[i] if valued[i] else None, last[i][2], last[i][0]]
        state.update(tuple(held))
        yield pd.DataFrame([row], columns=names, dtype=object)

    store = "{0}_n long, {0}_mean double, {0}_last double"
    schema = f"node long, last_update long, {store.format('sent')}, {store.format('got')}"
    return ends.groupBy("node").applyInPandasWithState(update, schema, f"{store.format('sent')}, sent_t long, {store.format('got')}, got_t long", "append", GroupStateTimeout.NoTimeout)


def quantised(events: DataFrame, block: int, size_ns: int) -> DataFrame:
    """The quantised windows of a stream that comes in time order, per source host (``by``): rows of closed windows. State is the open window's start, count and last time."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, in_block, tw = state.get if state.exists else (-1, 0, 0, 0)
        out = []
        for t in pd.concat(list(parts)).sort_values(["t", "event_uuid"])["t"]:
            start = int(t) if start < 0 else start
            n, in_block = n + 1, in_block + 1
            if in_block == block:
                in_block = 0
                if t > start + size_ns:
                    out.append((key[0], tw, start, int(t), n))
                    start, n, tw = int(t), 0, tw + 1
        state.update((start, n, in_block, tw))
        yield pd.DataFrame(out, columns=["by", "tw", "start_ns", "end_ns", "n"])

    return events.groupBy("by").applyInPandasWithState(update, "by long, tw long, start_ns long, end_ns long, n long", "start long, n long, in_block long, tw long", "append", GroupStateTimeout.NoTimeout)

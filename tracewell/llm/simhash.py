"""SimHash near-duplicates through pigeonhole blocks.

A fingerprint is cut into five blocks of 13 or 12 bits. Two fingerprints that differ in at most three bits agree in
at least two blocks, so each of the ten pairs of blocks is a join key of 25 or 26 bits: no close pair is missed,
and chance meetings stay few even among billions. Distinct fingerprints only are joined. A key with
more than ``tile`` of them is dealt to pairs of tiles, so no task holds more than two tiles, and each
group of a task gives a spanning forest of its verified links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import bounded, discard, frugal, materialise, to_python
from tracewell.llm.components import components

SHINGLE, SEED, DISTANCE, TILE = 3, 42, 3, 2048
#: Fingerprints of more than one row in so many are joined back by a broadcast of their own.
HOT = 4096
WIDTHS = (13, 13, 13, 13, 12)
CHUNK = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text, as a signed 64-bit number. bytes.lower() and split() know ASCII only, as asked for."""
    found = (raw or b"").lower().split()
    if not found:
        return 0
    text = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - shingle + 1)
    last = ends[min(shingle, len(found)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(first[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(text[s:e], seed) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint as a long) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("raw"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())], ["doc_id", "fingerprint"])

    return to_python(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def block_keys(fp: str) -> Column:
    """The ten block-pair keys of a fingerprint: number of the pair, then the bits of both blocks."""
    blocks, low = [], 64
    for width in WIDTHS:
        low -= width
        blocks.append(F.shiftrightunsigned(F.col(fp), low).bitwiseAND((1 << width) - 1))
    return F.array(*[F.lit(k << 26).bitwiseOR(F.shiftleft(blocks[i], 13)).bitwiseOR(blocks[j]) for k, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))])


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what chains of close pairs connect within one group: (root, member), at most one for each member."""
    rest, links = np.unique(fps), []
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and rest.size:
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                hit, rest = rest[near], rest[~near]
                front.extend(hit)
                links.extend((root, x) for x in hit)
    return links


def close_links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints at most ``distance`` apart (three at most)."""
    keyed = fps.select("fingerprint").distinct().select("fingerprint", F.explode(block_keys("fingerprint")).alias("key"))
    keyed = materialise(keyed, "blocks")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int")
    met = keyed.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
    met = met.where("tiles = 1 OR own != other").select("key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "fingerprint")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] = [np.empty((0, 4), np.int64)]

        def links(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            found = [x for part in np.split(rows[:, 3].view(np.uint64), cuts) for x in forest(part, distance)]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in frugal(batches):
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([*tail, rows])
            open_at = int(np.flatnonzero((rows[:, :3] == rows[-1, :3]).all(axis=1))[0])
            if open_at:
                yield links(np.ascontiguousarray(rows[:open_at]))
            tail = [rows[open_at:]]
        if tail[0].size:
            yield links(np.ascontiguousarray(tail[0]))

    return met.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u").mapInArrow(verify, "a long, b long")


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Texts without words (null, empty, white space) have fingerprint zero and link like any other. Equal rows are
    rows of one fingerprint. A null doc_id is never the smallest, unless no other is there.
    """
    fps = materialise(fingerprints(docs, text, id_col), "fingerprints")
    nodes = fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = materialise(components(close_links(fps)), "roots")
    linked = roots.join(nodes, roots.node == nodes.fingerprint)
    least = linked.groupBy("root").agg(F.min("least").alias("reached"))
    reached = roots.join(least, "root").select(F.col("node").alias("fingerprint"), "reached")
    ids = materialise(nodes.join(reached, "fingerprint", "left").select("fingerprint", F.coalesce("reached", "least").alias("component_id"), "n"), "ids")
    hot = F.broadcast(ids.where(F.col("n") * HOT > fps.count()).drop("n"))  # fewer than HOT rows
    rest = fps.join(hot, "fingerprint", "left_anti").join(ids.drop("n"), "fingerprint")
    return fps.join(hot, "fingerprint").unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id is its component's; of rows that repeat such an id, all. Rows of one id and other texts are decided one by one."""
    groups = near_groups(docs, text, id_col).withColumn("gone", F.col("doc_id") != F.col("component_id"))
    by_id = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("gone").alias("gone"), F.min("gone").alias("whole"))
    by_id = materialise(by_id.where("gone"), "near-copies")
    gone = by_id.where("whole").select(F.col("doc_id").alias(id_col))
    mixed = materialise(by_id.where("NOT whole").select("doc_id"), "mixed-ids")
    if mixed.isEmpty():
        return discard(docs, gone, id_col)
    kept = materialise(groups.where("NOT gone").join(bounded(mixed), "doc_id", "left_semi").select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__kept")).distinct(), "mixed-kept")
    rows = marked(docs.join(bounded(mixed.select(F.col("doc_id").alias("__id"))), F.col(id_col) == F.col("__id"), "left_semi"), text)
    rows = rows.join(bounded(kept), (F.col(id_col) == F.col("__id")) & (F.col("__fingerprint") == F.col("__kept")), "left_semi").drop("__fingerprint")
    return discard(docs, by_id.select(F.col("doc_id").alias(id_col)), id_col).unionByName(rows)


def marked(docs: DataFrame, text: str) -> DataFrame:
    """docs with the fingerprint of each row in 16 hex digits, __fingerprint."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            found = [format(fingerprint(x.as_py()) & (1 << 64) - 1, "016x") for x in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "__fingerprint"])

    return to_python(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fingerprint", T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of every partition are merged into candidates for frequent digests. An exact count
verifies them; the verified winners (at most ``counters`` rows, whatever the input) are broadcast, so the rows of
hot groups are settled where they are read. All other digests have at most a 1/counters share of the rows
each and are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.llm.common import bounded, discard, materialise, without_spaces

COUNTERS = 4096


def _trim(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keeps k counters at most by subtracting the (k+1)-th largest count from all: the Misra-Gries merge."""
    if len(keys) > k:
        counts = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def misra_gries(digests: DataFrame, k: int) -> DataFrame:
    """(digest, estimate): every digest with more than a 1/k share of the rows is among them. Estimates are at most the true counts."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, object), np.empty(0, np.int64)
        for batch in batches:
            seen = batch.column(0).value_counts()
            keys = np.concatenate([keys, np.array(seen.field(0).to_pylist(), object)])
            counts = np.concatenate([counts, seen.field(1).to_numpy(zero_copy_only=False)])
            keys, at = np.unique(keys, return_inverse=True)
            keys, counts = _trim(keys, np.bincount(at, counts, len(keys)).astype(np.int64), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.binary()), pa.array(counts, pa.int64())], ["digest", "estimate"])

    return digests.mapInArrow(summarise, "digest binary, estimate long").groupBy("digest").agg(F.sum("estimate").alias("estimate")).orderBy(F.desc("estimate"), "digest").limit(k)


def group_rows(docs: DataFrame, text: str = "text", id_col: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; null is the empty text. Of a group the row
    with the most code points in its original text stays, then the smallest id (a null id comes last). Rows that repeat an
    id are rows of their own: of rows equal in id and length all are marked as kept, and ``dedup`` leaves one of
    them. Columns besides id and text are not looked at; an empty table gives an empty result.
    """
    rank = F.struct((-F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("longest"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    narrow = materialise(docs.select(rank.alias("rank"), F.unhex(F.sha2(without_spaces(F.col(text)), 256)).alias("digest")), "digests")
    total = narrow.count()
    found = F.struct(F.min("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
    heavy = narrow.join(F.broadcast(misra_gries(narrow.select("digest"), counters).select("digest")), "digest", "left_semi")
    heavy = materialise(heavy.groupBy("digest").agg(found.alias("found")).where(F.col("found.group_size") * counters > total), "winners")
    hot = narrow.join(F.broadcast(heavy), "digest")
    w = W.partitionBy("digest")
    rest = narrow.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").withColumn("found", F.struct(F.min("rank").over(w).alias("best"), F.count(F.lit(1)).over(w).alias("group_size")))
    return hot.unionByName(rest).select(
        F.col("rank.id").alias("doc_id"), F.col("found.best.id").alias("keep_id"), F.col("found.group_size").alias("group_size"),
        (F.col("rank") == F.col("found.best")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows equal in id and text after deleting white space count as one."""
    verdict = materialise(group_rows(docs, text, id_col, counters).select("doc_id", "kept"), "verdict")
    ids = verdict.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay"))
    ids = materialise(ids.where("n > 1 OR stay = 0").withColumnRenamed("doc_id", id_col), "ids")
    out = discard(docs, ids.where("stay = 0").select(id_col), id_col)
    again = ids.where("stay > 0")
    if not again.count():
        return out
    # ids that come more than once and stay at least once: their rows are deduplicated as whole texts
    twice = out.join(bounded(again.select(F.col(id_col).alias("__twice"))), F.col(id_col).eqNullSafe(F.col("__twice")), "left_semi")
    own = W.partitionBy(id_col, F.sha2(without_spaces(F.col(text)), 256)).orderBy(F.desc(F.char_length(F.coalesce(F.col(text), F.lit("")))))
    best = twice.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
    stay = group_rows(docs, text, id_col, counters).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    best = best.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (F.sha2(without_spaces(F.col(text)), 256) == F.col("__sha")), "left_semi")
    return discard(out, again.select(id_col), id_col).unionByName(best)


def query(spark, sf_dir: str) -> DataFrame:
    return group_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

"""Histograms of many keys in chunks, and sums over them in numpy tasks.

A chunk is a row of up to ``CHUNK`` values of one key: a key with a third of all values is many rows, which Spark deals to tasks like any other, and a key with few is one. A task gives sums for each chunk; those of a key are added by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.running import running
from tracewell.operators.storage import written

#: Values of a chunk, and values that a task works on at a time, at most.
CHUNK, VALUES = 256, 1 << 17
#: Added where a share is cut into slices, so that rounding alone does not decide what lies on an edge.
EDGE = 1e-9

Sums = tuple[np.ndarray, list[np.ndarray | pa.Array]]


def packed(hist: DataFrame, *key: str) -> DataFrame:
    """(key, xs, ns, uptos): the values of each key in order, with their counts and the running sums of these over the whole key, in chunks."""
    placed = running(hist.select(*key, "x", "n"), list(key), [*key, "x"], upto=F.col("n"), i=F.lit(1).cast("long"))
    rows = placed.groupBy(*key, F.floor((F.col("i") - 1) / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("x", "n", "upto"))).alias("v"))
    return written(rows.select(*key, F.col("v.x").alias("xs"), F.col("v.n").alias("ns"), F.col("v.upto").alias("uptos")), "chunks")


def summed(chunks: DataFrame, sums: Callable[[pa.RecordBatch], Sums], more: str, *key: str) -> DataFrame:
    """(key, more): what ``sums`` makes of some chunks at a time, as places of chunks among them and columns."""
    schema = T.StructType([*(chunks.schema[k] for k in key), *T._parse_datatype_string(more).fields])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(_lengths(batch.column("xs")))
            first = 0
            while first < len(batch):
                done = upto[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(upto, done + VALUES, "right")))
                piece = batch.slice(first, end - first)
                places, columns = sums(piece)
                yield pa.RecordBatch.from_arrays([*(piece.column(k).take(pa.array(places)) for k in key), *(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns)], names=schema.names)
                first = end

    return chunks.mapInArrow(task, schema)


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _opened(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, the value and the count of each value."""
    return np.repeat(np.arange(len(piece)), _lengths(piece.column("xs"))), _flat(piece.column("xs")), _flat(piece.column("ns"))


def places(most: int) -> Iterator[tuple[int, slice]]:
    """The cells of each number of clusters k: one more than k, for values whose share of the count rounds up to 1."""
    at = 0
    for k in range(1, most + 1):
        yield k, slice(at, at + k + 1)
        at += k + 1


def _cells(piece: pa.RecordBatch, most: int, label: Callable[[int, slice], tuple[np.ndarray, np.ndarray]]) -> Sums:
    """For each chunk the sums of n, nx and nxx in all cells, as one list. label gives the cell of each value among those of k, and the chunks without that k."""
    owner, x, n = _opened(piece)
    out = np.zeros((len(piece), sum(k + 1 for k in range(1, most + 1)), 3))
    for k, cells in places(most):
        place, none = label(k, cells)
        for i, w in enumerate((n, n * x, n * x * x)):
            out[:, cells, i] = np.bincount(owner * (k + 1) + place, w, len(piece) * (k + 1)).reshape(-1, k + 1)
        out[none, cells] = 0
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(piece) + 1) * out[0].size, pa.int32()), pa.array(out.ravel()))
    return np.arange(len(piece)), [lists]


def sliced(piece: pa.RecordBatch, most: int) -> Sums:
    """Sums of slices of equal weight: 1 to most of them, but no more than the key's distinct values."""
    owner, _, n = _opened(piece)
    total, distinct = (piece.column(c).to_numpy() for c in ("total", "distinct"))
    share = (_flat(piece.column("uptos")) - n / 2) / total[owner]
    return _cells(piece, most, lambda k, _: (np.clip(np.floor(k * share + EDGE), 0, k).astype(int), distinct < k))


def nearest(piece: pa.RecordBatch, most: int) -> Sums:
    """Sums of the values nearest to each centre, the first of those that are equally near but for rounding. A cell without a centre has an infinite one."""
    owner, x, _ = _opened(piece)
    centres = _flat(piece.column("centres")).reshape(len(piece), -1)

    def label(_: int, cells: slice) -> tuple[np.ndarray, np.ndarray]:
        d = np.abs(x[:, None] - centres[owner, cells])
        return (d <= d.min(axis=1, keepdims=True) * (1 + 1e-9)).argmax(axis=1), np.isinf(centres[:, cells.start])

    return _cells(piece, most, label)


def shared(piece: pa.RecordBatch) -> Sums:
    """k, and sums of the responsibilities of each component, times x and x^2, their entropy, and the log-likelihood with the first component, for components with log density base - (x - mean)^2 / (2 var)."""
    owner, x, n = _opened(piece)
    size = _lengths(piece.column("base"))
    chunk = np.repeat(np.arange(len(piece)), size)
    k = np.arange(len(chunk)) - np.repeat(np.cumsum(size) - size, size)
    table = {}
    for name, none in (("base", -np.inf), ("mean", 0.0), ("var", 1.0)):
        table[name] = np.full((len(piece), size.max()), none)
        table[name][chunk, k] = _flat(piece.column(name))
    far = x[:, None] - table["mean"][owner]
    p = table["base"][owner] - far * far / (2 * table["var"][owner])
    top = p.max(axis=1)
    whole = top + np.log(np.exp(p - top[:, None]).sum(axis=1))
    q = p - whole[:, None]
    r = n[:, None] * np.exp(q)
    entropy = np.where(r > 0, -r * np.where(np.isinf(q), 0.0, q), 0.0)
    total = lambda w: np.stack([np.bincount(owner, c, len(piece)) for c in w.T], axis=1)[chunk, k]
    loglik = np.where(k == 0, np.bincount(owner, n * whole, len(piece))[chunk], 0.0)
    return chunk, [k.astype(np.int32), total(r), total(r * x[:, None]), total(r * (x * x)[:, None]), total(entropy), loglik]

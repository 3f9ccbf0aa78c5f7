"""Sums of small matrices over all rows: each task adds up its own rows, and the tasks' matrices are summed row by row in a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import frugal, to_python


def summed(rows: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all batches of rows of what ``add(total, batch)`` adds to a matrix of that shape. The driver gets the matrix alone, whatever the number of tasks."""
    height, width = shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in frugal(batches):
            add(total, batch)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], ["i", "v"])

    parts = to_python(rows).mapInArrow(run, "i int, v array<double>")
    out = np.zeros(shape)
    for r in parts.groupBy("i").agg(F.array(*(F.sum(F.get("v", F.lit(j))) for j in range(width))).alias("v")).collect():
        out[r.i] = r.v
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of that length, none null, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

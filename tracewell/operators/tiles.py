"""Nearest points of a tile: a block of queries against a block of points, as Spark deals them to tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries at a time, and pairs whose distance is taken exactly at a time.
ROWS, PAIRS = 128, 1 << 17


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _exact(q: np.ndarray, p: np.ndarray, qi: np.ndarray, pi: np.ndarray) -> np.ndarray:
    out = np.zeros(len(qi))
    for i in range(0, len(qi), PAIRS):
        s = slice(i, i + PAIRS)
        for j in range(q.shape[1]):
            d = q[qi[s], j] - p[pi[s], j]
            out[s] += d * d
    return np.sqrt(out)


def closest(left: pa.Table, right: pa.Table, k: int, own: bool, digits: int | None) -> pa.Table:
    """(q, p, dist, n) of the nearest points of each query, copies (n) counted, until there are k; ties to the smaller p. A matrix product finds who can be among them, within its rounding error; what counts is the distance taken entry by entry. With ``own`` one copy of the query itself is left out."""
    empty = pa.table({"q": left["q"][:0], "p": right["p"][:0], "dist": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
    if not len(left) or not len(right):
        return empty
    q, p = _matrix(left["qv"]), _matrix(right["pv"])
    n = right["n"].to_numpy()
    ids = np.unique(np.concatenate([left["q"].to_numpy(), right["p"].to_numpy()]), return_inverse=True)[1]
    q_id, rank = ids[: len(q)], ids[len(q) :]
    qq, pp = (q * q).sum(1), (p * p).sum(1)
    error = 1e-11 * (pp.max() + qq.max())
    found = []
    for i in range(0, len(q), ROWS):
        d2 = qq[i : i + ROWS, None] + pp - 2 * (q[i : i + ROWS] @ p.T)
        if len(p) > k + own:
            last = np.partition(d2, k + own - 1, axis=1)[:, k + own - 1]
            reach = (np.sqrt(np.maximum(last + error, 0)) + 2e-9) ** 2 + error
            qi, pi = np.nonzero(~(d2 > reach[:, None]))
        else:
            qi, pi = (x.ravel() for x in np.indices(d2.shape))
        qi += i
        dist, copies = _exact(q, p, qi, pi), n[pi] - (own & (q_id[qi] == rank[pi]))
        if digits is not None:
            dist = np.round(dist, digits)
        order = np.lexsort((rank[pi], dist, qi))
        order = order[copies[order] > 0]
        qi, pi, dist, copies = qi[order], pi[order], dist[order], copies[order]
        upto = np.cumsum(copies)
        start = np.searchsorted(qi, qi)  # the first row of each query
        kept = upto - copies - np.where(start > 0, upto[start - 1], 0) < k
        found.append((qi[kept], pi[kept], dist[kept], copies[kept]))
    qi, pi, dist, copies = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"q": left["q"].take(pa.array(qi)), "p": right["p"].take(pa.array(pi)), "dist": dist, "n": copies.astype(np.int64)})


def tiled(queries: DataFrame, points: DataFrame, keys: list[str], k: int, own: bool, digits: int | None = None) -> DataFrame:
    """(q, p, dist, n) of each tile: queries (keys, q, qv) against points (keys, p, pv, n), vectors without nulls. A tile is all rows with the same keys on both sides."""
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *points.schema]}
    pairs = queries.groupBy(*keys).cogroup(points.groupBy(*keys))
    found = pairs.applyInArrow(lambda a, b: closest(a, b, k, own, digits), f"q {kind['q']}, p {kind['p']}, dist double, n long")
    return found.where(F.col("q").isNotNull())

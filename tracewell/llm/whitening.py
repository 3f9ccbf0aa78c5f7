"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. A pass over all rows gives V Q for a block Q of WIDTH columns: each task adds up
its centred rows' products, one small matrix for each task. A few Lanczos steps bound the low end of the spectrum. A round then runs the
Chebyshev recurrence over such passes, which damps what lies between that bound and the least wanted value of the block and lets the rest grow like a
cosh; QR makes the block orthonormal, and Rayleigh-Ritz turns it to approximate eigenvectors. Rounds end when the residuals |V q - e q| of all
wanted pairs are certified to be within TOLERANCE of the largest eigenvalue.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import frugal, materialise, to_python
from tracewell.llm.sums import matrix, summed

COMPONENTS, SPARE = 8, 24
#: Degree of a round's polynomial, steps that bound the spectrum, rounds at most, residual over the largest eigenvalue.
DEGREE, LANCZOS, ROUNDS, TOLERANCE = 10, 10, 30, 2e-14
#: Residuals that no longer fall are accepted up to here: what rounding leaves.
ACCEPTED = 1e-12
SCALE, OFFSET = 1024, 100_000
LONG = 2**63 - 1


class Fit(NamedTuple):
    """What is known of the fit list: rows, dimensions, exact sums, whether n * x can leave 64 bits, and the trace of V."""

    n: int
    sums: list[int]
    wide: bool
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if self.wide:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n


def fit_list(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows whose vector is not null, not empty and has finite entries only, none so large that 1024 times it leaves 62 bits; x are whole numbers. Of several lengths the most frequent stays (of equally frequent ones the shortest)."""
    v = F.col(vec).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | ~(F.abs(c) < float(2**52)))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    rows = materialise(vectors.where(fine).select(F.col(id_col).alias("vec_id"), x.alias("x")), "vectors")
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("x") == size.d) if size else rows


def measured(rows: DataFrame) -> Fit:
    """Exact sums: each task adds up whole numbers, the tasks' sums are added as decimals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most, n = 0, 0, 0
        for batch in frugal(batches):
            if batch.num_rows:
                x = matrix(batch.column(0), len(batch.column(0)[0]))
                peak = int(np.abs(x).max())
                total = total + (x.sum(axis=0) if peak * len(x) < LONG else x.astype(object).sum(axis=0)).astype(object)
                most, n = max(most, peak), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(map(str, total))), pa.array([most] * len(total), pa.int64()), pa.array([n] * len(total), pa.int64())], ["i", "s", "most", "n"])

    parts = to_python(rows.select("x")).mapInArrow(run, "i int, s string, most long, n long")
    found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("most").alias("most"), F.sum("n").alias("n")).orderBy("i").collect()
    if not found:
        return Fit(0, [], False, 0.0)
    n, most = found[0].n, max(r.most for r in found)
    known = Fit(n, [int(r.s) for r in found], 2 * most * n >= LONG, 0.0)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        c = known.centred(matrix(batch.column(0), len(found)))
        total += (c * c).sum(axis=0)[:, None]

    return known._replace(trace=float(summed(rows.select("x"), (len(found), 1), add).sum() / n))


def product(rows: DataFrame, fit: Fit, block: np.ndarray) -> np.ndarray:
    """V Q by one pass over all rows."""
    d = len(fit.sums)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        c = fit.centred(matrix(batch.column(0), d))
        total += c.T @ (c @ block)

    return summed(rows.select("x"), block.shape, add) / fit.n


def low_end(times, d: int, rng: np.random.Generator, steps: int = LANCZOS) -> float:
    """An estimate of the smallest eigenvalue, from below where Lanczos has not yet settled; never negative."""
    basis, alphas, betas = [(q := rng.standard_normal(d)) / np.linalg.norm(q)], [], []
    for _ in range(min(steps, d)):
        w = times(basis[-1][:, None])[:, 0]
        alphas.append(basis[-1] @ w)
        for _ in range(2):
            for q in basis:
                w = w - (q @ w) * q
        betas.append(np.linalg.norm(w))
        if betas[-1] <= 1e-10 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, values[0] - betas[-1] * abs(vectors[-1, 0]))


def filtered(times, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """A Chebyshev polynomial of V applied to q: of size 1 on [low, high], growing beyond, scaled so that it stays near 1 at top. vq is V q."""
    centre, half = (high + low) / 2, (high - low) / 2
    first = sigma = half / (top - centre)
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, 2 * following / half * (times(now) - centre * now) - sigma * following * before
        sigma = following
    return now


def leading(rows: DataFrame, fit: Fit, k: int = COMPONENTS, spare: int = SPARE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of V, their unit eigenvectors as columns, and the largest residual over the largest eigenvalue. Fewer if there are fewer dimensions."""
    d, rng = len(fit.sums), np.random.default_rng(seed)
    k, width = min(k, d), min(k + spare, d)
    times = lambda q: product(rows, fit, q)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    low, worst = low_end(times, d, rng) if width < d else 0.0, float("inf")
    for turn in range(ROUNDS):
        vq = times(q)
        small = q.T @ vq
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, vq = q @ turned, vq @ turned
        before, worst = worst, float(np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max() / max(values[0], 1e-300))
        if values[0] <= 0 or worst <= TOLERANCE or (worst <= ACCEPTED and worst > before / 2):
            break
        high = max(values[width // 2 if turn == 0 else width - 1], low + 1e-3 * (values[0] - low))  # no Ritz value exceeds the eigenvalue of its number, so what is wanted is never damped
        q = np.linalg.qr(filtered(times, q, vq, low, high, values[0]))[0]
    else:
        warnings.warn(f"after {ROUNDS} rounds a residual is still {worst} of the largest eigenvalue", stacklevel=2)
    return values[:k], q[:, :k], worst


def whiten(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """One row for each vector of the fit list and each of its first k components (fewer if there are fewer dimensions).

    (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact). Rows with a null vector, an empty one, or null or non-finite entries are left out, as are entries beyond
    2^52 and vectors of another length than most. Repeated ids and vectors count as often as they are there. A component without variance (less
    than 1e-12 of the trace) has null in whitened; identity_error is over the others, null if there are none. deviation is null where 64 bits can't hold it,
    deviation_exact where 38 digits can't. No usable vector gives an empty result.
    """
    rows = fit_list(vectors, vec, id_col)
    fit = measured(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {kind}, deviation long, deviation_exact decimal(38,0), w array<double>"
    values, parts = np.zeros(0), np.zeros((len(fit.sums), 0))
    if fit.n:
        values, parts, _ = leading(rows, fit, k)
    alive = values > 1e-12 * fit.trace
    axes = parts[:, alive] / np.sqrt(values[alive])
    error = None
    if alive.any():
        m = axes.shape[1]

        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            w = fit.centred(matrix(batch.column(0), len(fit.sums))) @ axes
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w

        got = summed(rows.select("x"), (m + 1, m), add) / fit.n
        error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(m)).max())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            if not batch.num_rows:
                continue
            a = fit.deviations(matrix(batch.column(1), len(fit.sums)))
            safe = not fit.wide and int(np.abs(a).max()) ** 2 * a.shape[1] < LONG
            squares = ((a if safe else a.astype(object)) ** 2).sum(axis=1).tolist()
            w = np.full((len(a), len(values)), np.nan)
            w[:, alive] = a.astype(np.float64) / fit.n @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * len(values), pa.int32()), pa.array(w.ravel(), from_pandas=True))
            exact = pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s if s <= LONG else None for s in squares], pa.int64()), exact, lists], ["vec_id", "deviation", "deviation_exact", "w"])

    out = to_python(rows).mapInArrow(run, columns).select("*", F.posexplode("w").alias("i", "whitened"))
    shares = F.array(*(F.lit(float(v / fit.trace) if fit.trace else 0.0) for v in values)) if len(values) else F.array().cast("array<double>")
    return out.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

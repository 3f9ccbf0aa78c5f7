import numpy as np
import pytest

from tracewell.llm import whitening


def table(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, x int, w int, n int").repartition(3)


def exact(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    return np.array([[n * a - b for a, b in zip(v, s, strict=True)] for v in x], object)


def held_against(got, vectors, k):
    a = exact(vectors)
    c = a.astype(float) / len(vectors)
    v = c.T @ c / len(vectors)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    got = got.orderBy("vec_id", "component").collect()
    assert [r.component for r in got] == list(range(1, k + 1)) * len(vectors) and {r.n for r in got} == {len(vectors)}
    assert [r.deviation for r in got[::k]] == (a * a).sum(axis=1).tolist() == [int(r.deviation_exact) for r in got[::k]]
    w, want = np.array([r.whitened for r in got]).reshape(-1, k), c @ u / np.sqrt(e)
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-8
    assert np.allclose([r.explained for r in got[:k]], e / np.trace(v), rtol=1e-9) and {r.identity_error < 1e-9 for r in got} == {True}


@pytest.mark.parametrize("d", [3, 12, 60])
def test_against_a_full_decomposition(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((150, d)) * (1 + np.arange(d) / d)).astype(np.float32).tolist()
    k = min(8, d)
    bad = [None, [], [1.0] * (d - 1) + [None], [float("nan")] * d, [1.0] * (d - 1) + [float("-inf")], [0.5] * (d + 1)]
    got = whitening.whiten(table(spark, vectors + bad))
    held_against(got, vectors, k)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_iteration_is_certified_and_needs_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((400, 96)) * 0.97 ** np.arange(96)).tolist()
    rows = whitening.fit_list(table(spark, vectors, "double"))
    fit = whitening.measured(rows)
    c = exact(vectors).astype(float) / len(vectors)
    passes = []
    monkeypatch.setattr(whitening, "product", lambda _, __, q: passes.append(q.shape[1]) or c.T @ (c @ q) / len(c))
    e, q, worst = whitening.leading(rows, fit)
    v = c.T @ c / len(c)
    assert worst < 1e-13 and len(passes) < 80 and np.allclose(q.T @ q, np.eye(8), atol=1e-13)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:8], rtol=1e-12) and np.linalg.norm(v @ q - q * e, axis=0).max() < 1e-12 * e[0]


def test_large_entries_few_rows_and_no_variance(spark):
    rng = np.random.default_rng(2)
    large = (rng.standard_normal((20, 4)) * 2.0**45).tolist() + [[2.0**60] * 4]
    got = whitening.whiten(table(spark, large, "double")).orderBy("vec_id", "component").collect()
    a = exact(large[:20])
    assert [int(r.deviation_exact) if r.deviation_exact is not None else None for r in got[::4]] == [s if s < 10**38 else None for s in (a * a).sum(axis=1)]
    assert {r.deviation for r in got} == {None} and len(got) == 80 and max(r.identity_error for r in got) < 1e-9
    same = whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(same) == 6 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, 0.0, None)}
    line = whitening.whiten(table(spark, [[float(i), 2.0 * i] for i in range(5)])).collect()
    assert {r.whitened is None for r in line if r.component == 1} == {False} and {r.whitened for r in line if r.component == 2} == {None}
    assert whitening.whiten(table(spark, [None, []])).collect() == []
    assert len(whitening.whiten(table(spark, [[1.0, 2.0]])).collect()) == 2

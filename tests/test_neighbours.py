"""Exact neighbours and outlier factors against brute force, with a crowd of equal vectors and ties."""

import sys

import numpy as np

from tracewell.operators import neighbours as m


def brute(points, queries, k, own):
    """Neighbours of each query row as (distance, representative): the k first by both."""
    rep = {}
    for i, v in enumerate(points):
        rep.setdefault(tuple(v), i)
    out = []
    for i, q in enumerate(queries):
        near = sorted((round(float(np.sqrt(((np.array(q) - v) ** 2).sum())), 9), rep[tuple(v)], j) for j, v in enumerate(points) if not (own and i == j))
        out.append([(d, r) for d, r, _ in near[:k]])
    return out


def factors(points, queries, k):
    near = brute(points, points, k, True)
    k_dist = {}
    for i, v in enumerate(points):
        k_dist.setdefault(min(j for j, w in enumerate(points) if w == v), near[i][-1][0])
    lrd = lambda pairs: 1 / (np.mean([max(d, k_dist[r]) for d, r in pairs]) + 1e-10)
    own = {r: lrd(near[r]) for r in k_dist}
    return [np.mean([own[r] for _, r in pairs]) / lrd(pairs) for pairs in brute(points, queries, k, False)]


def test_factors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [tuple(v) for v in np.round(np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(8, 0.3, (30, 2)), np.tile([[5.0, 5.0]], (35, 1)), rng.integers(0, 3, (20, 2))]), 3).tolist()]
    queries = points[:10] + [(5.0, 5.0), (100.0, -3.0), (4.0, 4.0), (1.0, 1.0), (1.0, 1.0)]
    table = lambda rows: spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "id long, x double, y double")
    for k, pivots in ((5, 4), (200, 7), (1, 1)):
        got = {r.id: r.lof for r in m.local_outlier_factors(table(points), table([*queries, (None, 1.0)]), ["x", "y"], "id", k, pivots).collect()}
        want = factors(points, queries, k)
        assert got.keys() == set(range(len(queries))) and np.allclose([got[i] for i in range(len(queries))], want, rtol=1e-6)
    assert want[0] and got[11] > 1.5
    assert m.local_outlier_factors(table(points[:0]), table(queries), ["x", "y"], "id", 3).count() == 0


def test_entry_without_an_optional_library(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("tracewell.llm") or n in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    import tracewell

    monkeypatch.delattr(tracewell, "llm", raising=False)
    import __spark_entry__ as entry

    assert len(entry.queries()) > 150 and "op4_simhash" not in entry.queries()
    sys.modules.pop("__spark_entry__")

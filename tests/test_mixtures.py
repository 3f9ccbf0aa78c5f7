"""Histogram mixtures against numpy, with a key that holds more than a third of all values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.special import digamma, lgamma
from tracewell.operators import mixtures as m


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    values = {"hot": np.round(np.concatenate([rng.normal(0, 1, 300), rng.normal(20, 2, 200)]), 2), "one": np.array([3.0]), "same": np.array([2.0, 2.0])}
    values |= {f"s{i}": np.round(rng.normal(5 * i, 1 + i, 40), 2) for i in range(4)}
    rows = [(k, float(x), 1) for k, v in values.items() for x in v] + [("hot", None, 2), ("hot", float("nan"), 3), ("s1", float("inf"), 4)]
    return values, spark.createDataFrame(rows, "key string, v double, total int").repartition(5)


def test_special_functions(spark):
    for v in (1e-3, 0.3, 1.0, 2.5, 40.0, 1e6):
        r = spark.range(1).select(digamma(F.lit(v)).alias("d"), lgamma(F.lit(v)).alias("g")).first()
        h = v * 1e-5
        assert r.g == pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-12) and r.d == pytest.approx((math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h), rel=1e-6)


def lloyd(x, k, rounds):
    x = np.sort(x)
    n = len(x)
    cum = np.array([(x <= v).sum() - (x == v).sum() / 2 for v in x])
    label = np.floor(k * cum / n + 1e-9)
    for _ in range(rounds):
        centres = np.array(sorted(x[label == c].mean() for c in np.unique(label)))
        d = np.abs(x[:, None] - centres)
        label = (d <= d.min(axis=1, keepdims=True) * (1 + 1e-9)).argmax(axis=1)
    return x, label


def test_mixtures_by_numpy(spark, series):
    values, rows = series
    got = {r.key: r for r in m.mixtures(rows, "v", "key", most=3, cluster_rounds=4, rounds=6, tolerance=0.0).collect()}
    assert got.keys() == values.keys()
    for key, x in values.items():
        inertia, parts = [], []
        for k in range(1, min(3, len(np.unique(x))) + 1):
            s, label = lloyd(x - x.mean(), k, 4)
            parts.append([(s[label == c].mean(), s[label == c].var(), (label == c).mean()) for c in np.unique(label)])
            inertia.append(sum(((s[label == c] - s[label == c].mean()) ** 2).sum() for c in np.unique(label)))
        best = parts[int(np.argmax(-np.diff(inertia))) + 1] if len(inertia) > 1 else parts[0]
        mean, var, weight = map(np.array, zip(*best, strict=True))
        least = 1e-10 * max(1.0, x.var()) + 1e-12
        var, s = np.maximum(var, least), x - x.mean()
        for _ in range(6):
            p = np.log(weight) - 0.5 * np.log(2 * np.pi * var) - (s[:, None] - mean) ** 2 / (2 * var)
            r = np.exp(p - p.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
            n = r.sum(axis=0)
            mean = (r * s[:, None]).sum(axis=0) / n
            var, weight = np.maximum((r * s[:, None] ** 2).sum(axis=0) / n - mean**2, least), n / len(x)
        want = sorted(zip(mean + x.mean(), var, weight, strict=True))
        assert got[key].n == len(x) and np.allclose([(c["mean"], c["var"], c["weight"]) for c in got[key].mixture], want, rtol=1e-6, atol=1e-8), key


def test_variational_finds_the_modes(spark, series):
    values, rows = series
    found = m.variational(m.histogram(rows, "v", "key"), 5, "key", rounds=12, tolerance=0.0)
    got = {r.key: r for r in found.collect()}
    assert got.keys() == values.keys() - {"one"} and len(got["same"].mixture) == 2
    for r in got.values():
        assert sum(c["weight"] for c in r.mixture) == pytest.approx(1) and all(c["var"] >= 1e-6 for c in r.mixture)
    heavy = sorted((c["mean"] for c in got["hot"].mixture if c["weight"] > 0.05))
    assert heavy[0] == pytest.approx(0, abs=1) and heavy[-1] == pytest.approx(20, abs=1)
    fewer = {r.key: r.bound for r in m.variational(m.histogram(rows, "v", "key"), 5, "key", rounds=4, tolerance=0.0).collect()}
    assert all(got[k].bound > b - 1e-6 for k, b in fewer.items())  # the bound rises


def test_quantiles_grid_and_bandwidth(spark, series):
    values, rows = series
    hist = m.histogram(rows, "v", "key")
    for r in m.quantiles(hist, {"a": 0.1, "b": 0.5, "c": 0.77}, "key").collect():
        assert np.allclose([r.a, r.b, r.c], np.quantile(values[r.key], [0.1, 0.5, 0.77]))
    for r in m.gridded(hist, 40, 0.1, "key").groupBy("key").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m"), F.count("g").alias("k")).collect():
        assert r.n == pytest.approx(len(values[r.key])) and r.m == pytest.approx(values[r.key].mean()) and r.k <= 40
    got = {r.key: r.h for r in m.bandwidth(hist, "key", points=256).collect()}
    assert got["one"] == got["same"] == 1.0
    for key in ("hot", "s1", "s3"):
        x = values[key]
        sigma = min(x.std(), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34)
        at = np.linspace(x.min() - 6 * sigma, x.max() + 6 * sigma, 4001)
        u = (at[:, None] - x) / sigma
        second = (np.exp(-0.5 * u * u) / np.sqrt(2 * np.pi) * ((at[:, None] - x) ** 2 - sigma**2) / sigma**5).mean(axis=1)
        rough = np.trapezoid(second**2, at) + 0.01 * x.var()
        assert got[key] == pytest.approx(1.06 * sigma * len(x) ** -0.2 / rough**0.2, rel=0.02)


def test_updates_keep_history(spark, series):
    values, rows = series
    old = m.mixtures(rows.where("key in ('hot', 's1', 'one')"), "v", "key", rounds=5, cluster_rounds=5).select("key", "n", "mixture")
    batch = spark.createDataFrame([("hot", 40.0)] * 100 + [("new", 1.0), ("new", 9.0)], "key string, v double")
    got = {r.key: r for r in m.updated(old, batch, "v", "key", rounds=5, cluster_rounds=5).collect()}
    assert got.keys() == {"hot", "s1", "one", "new"} and got["hot"].n == pytest.approx(600) and got["new"].n == 2
    mean = sum(c["mean"] * c["weight"] for c in got["hot"].mixture)
    assert mean == pytest.approx((values["hot"].sum() + 4000) / 600, rel=1e-6)
    assert got["s1"].mixture == old.where("key = 's1'").first().mixture and got["s1"].loglik is None


def test_summaries_of_mixtures(spark):
    rows = spark.createDataFrame([("a", 3.0, [(0.0, 1.0, 0.7), (5.0, 1.0, 0.3)]), ("b", 2.0, [(1.0, 4.0, 1.0)])], "key string, n double, mixture array<struct<mean:double,var:double,weight:double>>")
    kept = rows.select("key", m.truncated("mixture", 0.5).alias("m")).where("key = 'a'").first().m
    assert [tuple(c) for c in kept] == [(0.0, 1.0, 1.0)]
    one = m.multimodal(rows).collect()
    assert [r.key for r in one] == ["a"] and one[0].entropy == pytest.approx(-0.7 * math.log(0.7) - 0.3 * math.log(0.3))
    hist = spark.createDataFrame([("a", 0.0, 2.0), ("a", 5.0, 1.0), ("c", 0.0, 1.0)], "key string, x double, n double")
    p = [0.7 / math.sqrt(2 * math.pi) + 0.3 * math.exp(-12.5) / math.sqrt(2 * math.pi), 0.3 / math.sqrt(2 * math.pi) + 0.7 * math.exp(-12.5) / math.sqrt(2 * math.pi)]
    got = m.average_nll(hist, rows, "key").collect()
    assert len(got) == 1 and got[0].nll == pytest.approx(-(2 * math.log(p[0]) + math.log(p[1])) / 3)
    assert m.storage(rows).first().asDict() == {"edges": 2, "times": 5.0, "components": 3, "ratio": 0.6, "least": 1, "most": 2, "median": 1.5}
    empty = spark.createDataFrame([], "key string, v double")
    assert m.mixtures(empty, "v", "key", rounds=1, cluster_rounds=1).count() == 0


def test_long_keys_go_in_chunks(spark):
    rng = np.random.default_rng(3)
    values = {"long": np.round(np.concatenate([rng.normal(0, 1, 500), rng.normal(30, 3, 200)]), 3), "short": np.array([1.0, 2.0, 2.0, 9.0])}
    values["long"] = np.unique(values["long"])
    hist = m.histogram(spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "key string, v double"), "v", "key")
    packs = m.packed(m.centred(hist, m.summary(hist, "key"), "key"), "key")
    sizes = {k: sorted(r.size for r in packs.selectExpr("key", "size(xs) AS size").collect() if r.key == k) for k in values}
    assert sizes == {"long": [len(values["long"]) % 256, *[256] * (len(values["long"]) // 256)], "short": [3]}
    got = {(r.key, r.k): r for r in m.kmeans(packs, 3, "key", rounds=4).collect()}
    assert got.keys() == {(key, k) for key in values for k in (1, 2, 3)}
    for (key, k), r in got.items():
        s, label = lloyd(values[key] - values[key].mean(), k, 4)
        want = [(s[label == c].mean(), s[label == c].var(), (label == c).sum()) for c in np.unique(label)]
        assert np.allclose([(p["mean"], p["var"], p["weight"]) for p in r.parts], want, rtol=1e-9, atol=1e-9)

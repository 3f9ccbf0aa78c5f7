"""Operators against plain loops: long groups in two levels, closures and traces without caps, queues, vectors of edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import features, graph, queues, reports, running, summaries, vectors, windows


def test_running_sums_and_numbers(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.randint(0, 9)) for i in r.sample(range(5000), 3000)]
    got = running.running(spark.createDataFrame(rows, "g string, k int, x int"), ["g"], [F.desc("k")], total=F.col("x"), n=F.lit(1)).collect()
    want, sums = {}, {}
    for g, k, x in sorted(rows, key=lambda t: -t[1]):
        s, n = sums.get(g, (0, 0))
        sums[g] = want[g, k] = (s + x, n + 1)
    assert {(x.g, x.k): (x.total, x.n) for x in got} == want
    one = running.numbered(spark.createDataFrame([(5,), (3,)], "k int"), [], ["k"]).collect()
    assert sorted((x.k, x.n) for x in one) == [(3, 1), (5, 2)]
    assert running.numbered(spark.createDataFrame([], "k int"), [], ["k"]).count() == 0


def test_trapezoids(spark):
    r = random.Random(2)
    curve = sorted((r.random(), r.random()) for _ in range(500))
    want = sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert running.trapezoids(spark.createDataFrame(curve, "x double, y double"), "x", "y").first().area == pytest.approx(want)
    assert running.trapezoids(spark.createDataFrame([], "x double, y double"), "x", "y").first().area == 0.0


def edge_table(spark, pairs):
    return spark.createDataFrame([(a, b, i + 1, i, "OPEN") for i, (a, b) in enumerate(pairs)], "src long, dst long, t long, event_uuid long, op string")


def test_long_chains_and_cycles(spark):
    """Nothing stops at a number of hops: a chain of 90 edges is followed to its end, a cycle of 80 is found."""
    chain = edge_table(spark, [(i, i + 1) for i in range(90)])
    got = graph.reach(chain, spark.createDataFrame([(0,)], "node long"))
    assert {r.node: r.hops for r in got.collect()} == {i: i for i in range(91)}
    back = graph.temporal_trace(chain, spark.createDataFrame([(90, 1000)], "node long, t long"))
    assert {(r.hop, r.node) for r in back.collect()} == {(h, 90 - h) for h in range(91)}
    loop = edge_table(spark, [(i, (i + 1) % 80) for i in range(80)] + [(200, 0), (5, 300)])
    assert {(r.src, r.dst) for r in graph.acyclic(loop).collect()} == {(200, 0), (5, 300)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 90)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 90]}, 100: 100, 101: 100, 103: 100}


def test_queues_against_one_pass(spark):
    r = random.Random(3)
    tws = list(range(60))
    related = sorted({tuple(sorted(r.sample(tws, 2))) for _ in range(45)})
    of, n = {}, 0
    for tw in tws:
        known = [of[a] for a, b in related if b == tw]
        of[tw] = min(known) if known else n
        n += not known
    got = queues.queues(spark.createDataFrame([(t,) for t in tws], "tw long"), spark.createDataFrame(related, "a long, b long"))
    assert {x.tw: x.queue for x in got.collect()} == of


def test_fresh_files_for_busy_processes(spark):
    """A process that touched most files still gets as many fresh ones as there are."""
    files = spark.range(100, 200).select(F.col("id").alias("node"))
    known = edge_table(spark, [(1, f) for f in range(100, 195)] + [(f, 2) for f in range(100, 110)])
    got = graph.synthetic_attacks(known, spark.createDataFrame([(1,), (2,), (3,)], "node long"), files, per_process=20)
    per = {p: {r.dst for r in got.where(f"src = {p}").collect()} for p in (1, 2, 3)}
    assert per[1] == set(range(195, 200)) and len(per[2]) == 20 and not per[2] & set(range(100, 110)) and len(per[3]) == 20


def test_neighbours_in_small_blocks(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: x.score for x in features.knn_scores(table, table.where("vec_id % 20 = 0"), k=5, block=7).collect()}
    v = np.array([x for _, x in rows])
    for i in (0, 20, 40):
        d = np.sort(np.linalg.norm(v - v[i], axis=1))[1:6]
        assert got[i] == pytest.approx(d.mean(), abs=1e-5)


def test_time_vectors_against_numpy(spark):
    r = np.random.default_rng(5)
    groups = {1: r.exponential(3, 40), 2: np.array([2.0, 2.0, 2.0]), 3: np.array([5.0]), 4: np.array([-1.0, 0.0, 4.0]), 5: np.array([1.0, 9.0])}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs]
    got = {x.k: [x[c] for c in vectors.PARTS] for x in vectors.time_vectors(spark.createDataFrame(rows, "k int, x double"), "x", "k").collect()}
    nodes, weights = np.polynomial.hermite.hermgauss(10)
    for k, xs in groups.items():
        x = xs[xs > 0]
        if len(x) < 2 or x.std() == 0:
            assert got[k] == [0.0] * 20
            continue
        m, s, h = x.mean(), x.std(), len(x) ** -0.2 * x.std(ddof=1)
        at = np.maximum(m + s * np.sqrt(2) * nodes[:5], 1e-6)
        kde = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi)) * weights[:5]
        z = (x - m) / s
        wave = [f(2 * np.pi * j * x / (m + 1e-6)).mean() for j in (1, 2, 3) for f in (np.cos, np.sin)]
        want = [*kde, m, s, (z**3).mean(), (z**4).mean() - 3, *wave, *np.percentile(x, [25, 50, 75]), len(x), np.ptp(x)]
        assert got[k] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_pseudo_points_keep_moments(spark):
    mixture = spark.createDataFrame([([(1.0, 4.0, 0.25), (9.0, 0.25, 0.75)],)], "mixture array<struct<mean:double,var:double,weight:double>>")
    points = mixture.select(F.explode(vectors.pseudo_points("mixture")).alias("p")).select("p.*").collect()
    x, w = np.array([p.x for p in points]), np.array([p.weight for p in points])
    assert w.sum() == pytest.approx(1) and (w * x).sum() == pytest.approx(7.0) and (w * x**2).sum() == pytest.approx(0.25 * (1 + 4) + 0.75 * (81 + 0.25))


def test_row_batches_and_windows_of_long_days(spark):
    rows = edge_table(spark, [(i % 3, i % 5) for i in range(1000)]).withColumn("day", F.lit(1))
    got = {r.event_uuid: r.batch for r in windows.row_batches(rows, 64, "day").collect()}
    assert got == {i: i // 64 for i in range(1000)}


def test_repairs_and_times(spark):
    edges = edge_table(spark, [(1, 2), (3, 4)])
    rows = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (1, 9, 0), (3, 4, 7)], "node long, neighbour long, e_id long")
    assert sorted((r.node, r.neighbour) for r in reports.repaired(rows, edges).collect()) == [(1, 2), (2, 1)]
    last = spark.createDataFrame([(0, 1, 5)], "batch int, node long, t long")
    got = {r.src: r.dt for r in reports.relative_times(edges.withColumn("batch", F.lit(0)), last).collect()}
    assert got == {1: 4, 3: None}


def test_only_the_nearest_leave_a_tile(spark):
    """Pairs stay in their task: crowds, ties, own copies and vectors with nulls against brute force, and no exchange of pairs."""
    from tracewell.operators import tiles

    r = np.random.default_rng(6)
    v = np.round(r.normal(size=(300, 3)), 1)
    v[100:200] = v[100]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(300, None), (320, [1.0, None, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: x.score for x in features.knn_scores(table, table.where("vec_id % 20 = 0"), k=5, block=64).collect()}
    assert got.pop(300) is None and got.pop(320) is None
    assert got == {i: pytest.approx(np.sort(np.delete(np.linalg.norm(v - v[i], axis=1), i))[:5].mean(), abs=1e-5) for i in range(0, 300, 20)}
    one = lambda c: table.where("vec_id < 300").select(F.lit(0).alias("part"), F.col("vec_id").alias(c), F.col("embedding").alias(f"{c}v"))
    assert tiles.tiled(one("q"), one("p").withColumn("n", F.lit(2).cast("long")), ["part"], 5, True, 9).groupBy("q").count().agg(F.max("count")).first()[0] <= 5


def test_martingales_beyond_the_largest_double(spark):
    hits = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("event_uuid"), F.col("id").alias("t"), F.lit(1).alias("hit"))
    got = summaries.martingale(hits, 0.1, 0.2, "k").where("t = 19999").first()
    assert got.log_m == pytest.approx(20_000 * (0.2 - math.log(0.9 + 0.1 * math.exp(0.2)))) and math.isinf(got.m)

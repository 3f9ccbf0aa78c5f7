import math

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text, times
from tracewell.operators import features, graph, labels, queues, ranking, reduction, scoring, summaries, walking, windows


def edges(spark, rows):
    """(src, dst, t, op) with event numbers in order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_uuid long, src string, dst string, t long, op string")


def test_quantised_windows_fixture(spark):
    rows = [("a", "b", t, "X") for t in (0, 3, 5, 12, 13, 14, 30)]
    e = edges(spark, rows).withColumn("day", F.lit(1))
    got = windows.quantised_windows(e, block=2, size_ns=10).groupBy("tw", "start_ns", "end_ns").count().orderBy("tw").collect()
    assert [tuple(r) for r in got] == [(0, 0, 12, 4), (1, 12, 30, 3)]
    assert windows.quantised_windows(e.limit(0), block=2, size_ns=10).count() == 0


def test_run_fusion_fixture(spark):
    e = edges(spark, [("a", "b", 1, "R"), ("a", "b", 2, "R"), ("a", "b", 3, "W"), ("a", "b", 4, "W"), ("a", "b", 5, "R")])
    assert sorted((r.op, r.t) for r in windows.fuse_runs(e).collect()) == [("R", 1), ("R", 5), ("W", 3)]


def test_minute_batches_fixture(spark):
    e = edges(spark, [("a", "b", t, "X") for t in (1, 4, 11, 19, 20)]).withColumn("day", F.lit(1))
    assert sorted((r.t, r.batch) for r in windows.minute_batches(e, 10, 5, "day").collect()) == [(1, 0), (4, 0), (11, 1), (20, 2)]


def test_pair_batches_fixture(spark):
    e = edges(spark, [(p[0], p[1], i, "X") for i, p in enumerate(["ab", "bc", "ab", "ab", "cd", "bc", "ab"])]).withColumn("day", F.lit(1))
    assert [r["count"] for r in windows.pair_batches(e, "day").groupBy("batch").count().orderBy("batch").collect()] == [2, 1, 3, 1]


def test_versions_fixture(spark):
    e = edges(spark, [("a", "b", 1, "X"), ("c", "b", 2, "X"), ("b", "a", 3, "X"), ("a", "b", 4, "X")])
    got = {(r.src, r.src_version, r.dst, r.dst_version) for r in graph.versioned(e).collect()}
    assert got == {("a", 0, "b", 0), ("c", 0, "b", 1), ("b", 0, "b", 1), ("b", 1, "a", 1), ("a", 0, "a", 1), ("a", 1, "b", 2), ("b", 1, "b", 2)}


def test_temporal_features_fixture(spark):
    e = edges(spark, [("k", "k", 10, "X"), ("k", "k", 20, "X"), ("k", "k", 60, "X"), ("k", "k", 60, "X"), ("z", "z", 0, "X"), ("z", "z", 100, "X")]).withColumn("tw", F.lit(0))
    r = reduction.temporal_features(reduction.collapse_all(e, "tw"), "tw").where("src = 'k'").first()
    assert (r.f_first, r.f_last, r.f_count) == pytest.approx((0.1, 0.6, math.log(5) / 10))


def test_max_loss_window_fixture(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 0, -1.0)], "node long, tw long, loss double")
    assert {r.node: r.tw for r in scoring.max_loss_window(rows).collect()} == {1: 1, 2: -1}


def test_idf_fixture(spark):
    rows = [("x", 0)] + [("y", w) for w in range(3)] + [("z", w) for w in range(8)]
    got = {r.node: r.idf for r in queues.idf(spark.createDataFrame(rows, "node string, tw int")).collect()}
    assert got["x"] == pytest.approx(1.386294) and got["y"] == pytest.approx(0.693147)


def test_queue_fixtures(spark):
    members = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "queue long, tw long")
    losses = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 0.5)], "tw long, loss double")
    assert queues.queue_scores(members, losses).first().score == pytest.approx(9.0)
    w = spark.createDataFrame([(1,), (2,), (3,), (4,)], "tw long")
    related = spark.createDataFrame([(1, 3, 1), (2, 4, 1), (3, 4, 1)], "a long, b long, shared long")
    assert sorted((r.tw, r.queue) for r in queues.queues(w, related).collect()) == [(1, 0), (2, 1), (3, 0), (4, 0)]


def test_moments_fixture(spark):
    r = reduction.moments(spark.createDataFrame([(0, float(x)) for x in (10, 20, 20, 50, 100)], "k int, x double"), "x", "k").first()
    assert (r["mean"], r.std, r.skew, r.kurt) == pytest.approx((40, 32.863353, 0.980491, -0.582305), abs=1e-5)


def test_score_fixtures(spark):
    one = spark.createDataFrame([([0.7, 0.2, 0.1],)], "p array<double>")
    assert one.select(scoring.threatrace_score("p")).first()[0] == pytest.approx(1.252763, abs=1e-6)
    w = spark.range(1).select(text.token_weights(F.lit(4), 30).alias("w")).first().w
    assert w == pytest.approx([0.3625, 0.2875, 0.2125, 0.1375])


@pytest.fixture
def ranked(spark):
    rows = [("a", 0.9, 1), ("b", 0.8, 0), ("c", 0.7, 1), ("d", 0.6, 0), ("e", 0.5, 1), ("f", 0.4, 0)]
    results = spark.createDataFrame([(ord(n), s, y) for n, s, y in rows], "node long, score double, y int")
    attacks = spark.createDataFrame([(0, ord("a")), (0, ord("c")), (1, ord("c")), (2, ord("e"))], "attack_id int, node_id long")
    return results, attacks


def test_ranking_fixture(ranked):
    results, attacks = ranked
    curve = {round(r.precision, 4): round(r.detected, 2) for r in ranking.adp_curve(results, attacks).collect()}
    assert curve == {0.0: 0.0, 0.5: 100.0, 0.6: 100.0, 0.6667: 66.67, 1.0: 33.33}
    assert ranking.area(ranking.adp_curve(results, attacks), "precision", "detected").first().area == pytest.approx(0.572222, abs=1e-6)
    r = ranking.until_all_detected(results, attacks).first()
    assert (r.fps, r.tps) == (2, 2)
    assert ranking.zero_fp_prefix(results).first().tps == 1
    assert scoring.roc_auc(results, "score", "y").first().auc == pytest.approx(0.666667, abs=1e-5)
    assert scoring.average_precision(results, "score", "y").first().average_precision == pytest.approx(0.755556, abs=1e-5)
    c = scoring.confusion(results, F.col("y"), (F.col("score") > 0.55).cast("int")).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.precision, c.recall, c.mcc, c.dor) == (2, 2, 1, 1, 0.5, 0.66667, 0.0, 1.0)
    d = {r.attack_id: r.score for r in ranking.discrimination(results, attacks).collect()}
    assert (d[0], d[1], d[2]) == pytest.approx((0.333333, 0.111111, -0.111111), abs=1e-5)


def test_two_means(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([1.0, 1.1, 0.9, 5.0, 5.2])], "node long, score double")
    assert {r.node for r in ranking.two_means_top(rows, 5).where("y_hat = 1").collect()} == {3, 4}


def test_graph_operators(spark):
    e = edges(spark, [("a", "b", 1, "X"), ("b", "c", 2, "X"), ("c", "a", 3, "X"), ("c", "d", 4, "X"), ("r", "a", 0, "X"), ("d", "d", 5, "X")])
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hops for r in graph.reach(e, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in graph.reach(e, seeds, backward=True).collect()} == {"a", "b", "c", "r"}
    assert {(r.src, r.dst) for r in graph.acyclic(e).collect()} == {("c", "d"), ("r", "a")}
    assert {r.node for r in graph.roots(e).collect()} == {"r"}
    back = {(r.entry, r.node) for r in graph.entry_components(e, spark.createDataFrame([("d",)], "node string")).collect()}
    assert back == {("r", x) for x in "rabcd"}
    trace = [(r.hop, r.node, r.t) for r in graph.temporal_trace(e, spark.createDataFrame([("d", 5)], "node string, t long")).orderBy("hop").collect()]
    assert trace == [(0, "d", 5), (1, "c", 4), (2, "b", 2), (3, "a", 1), (4, "r", 0)]
    both = graph.undirected(e)
    assert both.count() == 2 * e.where("src != dst").count() + 1


def test_negatives_and_walks(spark):
    e = edges(spark, [(f"n{i}", f"m{(i * 7) % 31}", i, "X") for i in range(200)])
    pairs = {(r.src, r.dst) for r in e.collect()}
    assert not pairs & {(r.src, r.dst) for r in walking.negatives(e).collect()}
    walk = walking.walks(edges(spark, [("a", "b", 1, "X"), ("b", "a", 2, "Y")]), 4, 1, temporal=True)
    assert {(r.start, r.step, r.node) for r in walk.collect()} >= {("a", 0, "a"), ("a", 1, "b"), ("a", 2, "a")}


def test_labels(spark):
    e = edges(spark, [("a", "b", 5, "X"), ("a", "c", 15, "X"), ("b", "b", 20, "X")])
    attacks = spark.createDataFrame([(0, 5, 20)], "attack_id int, start_ns long, end_ns long")
    bad = spark.createDataFrame([(0, "b")], "attack_id int, node_id string")
    n = {s: labels.malicious_edges(e, attacks, bad, s).count() for s in labels.SELECTIONS}
    assert n == {"src_node": 1, "dst_node": 2, "both_nodes": 1, "either_node": 2}
    tw = spark.createDataFrame([(0, 0, 20), (1, 20, 40)], "tw long, start_ns long, end_ns long")
    assert [(r.tw, r.node_id, r.n) for r in labels.malicious_per_window(e, tw, attacks, bad).collect()] == [(0, "b", 1)]


def test_triplets_and_one_hot(spark):
    rows = spark.createDataFrame([("subject", "file", "EVENT_READ"), ("subject", "subject", "EVENT_WRITE")], "src_type string, dst_type string, op string")
    assert sorted(r.triplet for r in features.with_triplets(rows, features.triplet_table(spark)).collect()) == [0, 1]
    assert features.triplet_table(spark).count() == 27
    assert spark.range(1).select(text.one_hot(F.lit(2), 4).alias("x")).first().x == [0, 0, 1, 0]


def test_times_round_trip(spark):
    t = 1_704_839_149_861_078_123
    r = spark.range(1).select(times.eastern(F.lit(t)).alias("s")).select("s", times.from_eastern(F.col("s")).alias("t")).first()
    assert r.s == "2024-01-09 17:25:49.861078123" and r.t == t
    assert spark.range(1).select(times.from_gmt_minus_4(F.lit("2019-09-25T10:00:00.12-04:00")).alias("t")).first().t == 1_569_420_000_012_000_000


def test_streams(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(10, 1, 80), rng.normal(100, 2, 40)])
    rng.shuffle(x)
    rows = spark.createDataFrame([(1, float(v), i) for i, v in enumerate(x)], "k int, x double, t long")
    means = [r["mean"] for r in summaries.stream_clusters(rows, "x", "k").collect()]
    assert min(abs(v - 10) for v in means) < 3 and min(abs(v - 100) for v in means) < 5
    assert summaries.ks_drift(rows.where("x < 50"), rows.where("x > 50"), "x", "k").first().ks == pytest.approx(1.0)


def test_context_vectors(spark):
    docs = spark.createDataFrame([(["a", "b", "c"],), (["a", "c"],)], "words array<string>")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 2.0])], "word string, vec array<double>")
    got = {r.word: (list(r.vec), r.n) for r in summaries.context_vectors(docs, vec, 1).collect()}
    assert got["b"] == ([3.0, 2.0], 2) and got["a"] == ([2.0, 3.0], 2)


def test_whole_seeds_and_windows(spark, tmp_path):
    """Closures from every node, queues, triage and degrees over all test windows, against brute force on a small table."""
    import datetime
    import json
    from collections import defaultdict

    from tracewell.plans import catalogue, more

    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=(i * 37) % 720), (i * 7) % 11, kinds[i % 5], float((i * 53) % 400), json.dumps({"k": (i * 5) % 13})) for i in range(240)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    e = catalogue.a.losses(spark, d).collect()
    test = [r for r in e if r.split == "test"]

    def closure(edges, start, hops=1000):
        seen, front = {start: 0}, {start}
        for hop in range(1, hops + 1):
            front = {y for x, y in edges if x in front} - seen.keys()
            seen |= dict.fromkeys(front, hop)
        return seen

    days = defaultdict(set)
    for r in e:
        days[r.day].add((r.src, r.dst))
    ends = {day: {x for p in ps for x in p} for day, ps in days.items()}
    ways = {day: {"f": ps, "b": {(y, x) for x, y in ps}} for day, ps in days.items()}
    want = {k: {(day, s, n, h) for day, w in ways.items() for s in ends[day] for n, h in closure(w[k], s).items()} for k in "fb"}
    assert {tuple(r) for r in catalogue.hop_counts_all(spark, d).select("day", "seed", "node", "hops").collect()} == want["f"]
    assert {tuple(r) for r in catalogue.descendants_all(spark, d).collect()} == {x[:3] for x in want["f"]}
    assert {tuple(r) for r in catalogue.ancestors_all(spark, d).collect()} == {x[:3] for x in want["b"]}
    assert {tuple(r) for r in catalogue.n_hop_all(spark, d).collect()} == {(day, s, n) for day, w in ways.items() for s in ends[day] for n in closure(w["f"] | w["b"], s, 2)}

    windows_ = {r.tw for r in test}
    of = defaultdict(set)
    for r in test:
        of[r.src].add(r.tw)
        of[r.dst].add(r.tw)
    idf = {n: round(math.log(len(windows_) / (len(ws) + 1)), 6) for n, ws in of.items()}
    assert {r.node: r.idf for r in catalogue.idf(spark, d).collect()} == pytest.approx(idf)
    pairs = [(x, y) for n, ws in of.items() if idf[n] > 1 for x in ws for y in ws if x < y]
    assert {(r.a, r.b): r.shared for r in catalogue.rare_shared_nodes(spark, d).collect()} == {p: pairs.count(p) for p in pairs}
    assert {r.tw for r in catalogue.queues(spark, d).collect()} == {r.tw for r in catalogue.queue_predictions(spark, d).collect()} == windows_

    score = defaultdict(float)
    for r in test:
        for n in (r.src, r.dst):
            score[r.tw, n] = max(score[r.tw, n], r.loss)
    parts, kept = set(), set()
    for tw, poi in [k for k, v in score.items() if v > 300]:
        ps = {(r.src, r.dst) for r in test if r.tw == tw}
        up = closure({(y, x) for x, y in ps}, poi).keys()
        into = {y for x, y in ps if x != y and x in up and y in up}
        found = {en: [n for n in closure(ps, en) if n in up] for en in up - into - {poi}}
        parts |= {(tw, poi, en, n) for en, ns in found.items() for n in ns}
        mean = {en: sum(score[tw, n] for n in ns) / len(ns) for en, ns in found.items()}
        kept |= {(tw, poi, n) for en, ns in found.items() if mean[en] == max(mean.values()) for n in ns} | {(tw, poi, poi)}
    assert {tuple(r) for r in catalogue.backward_component_flagged(spark, d).select("tw", "poi", "entry", "node").collect()} == parts
    assert {tuple(r) for r in catalogue.triage(spark, d).select("tw", "poi", "node").collect()} == kept
    assert {(r.day, r.node) for r in more.degree_scaled(spark, d).collect()} == {(day, n) for day, ns in ends.items() for n in ns}


def test_closures_of_long_chains(spark):
    e = edges(spark, [(f"n{i}", f"n{i + 1}", i, "X") for i in range(66)])
    assert graph.reach(e, spark.createDataFrame([("n0",)], "node string")).count() == 67


def test_divergence_deals_keys_to_tasks(spark, monkeypatch):
    """Tasks grow with keys, so that none sums the grid points of many; the result stays."""
    import numpy as np

    from tracewell.operators import vectors

    rng = np.random.default_rng(1)
    data = {k: rng.normal(k, 1 + k, 12) for k in range(40)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [(99, 1.0), (None, 2.0)], "k long, x double")
    one = rows.groupBy("k").agg(F.array(F.struct(F.avg("x").alias("mean"), F.pow(F.stddev_pop("x"), F.lit(2)).alias("var"), F.lit(1.0).alias("weight"))).alias("mixture"))
    monkeypatch.setattr(vectors, "SUMS", 512)
    found = vectors.divergence(rows, one, "x", "k")
    assert "hashpartitioning(k#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan  # 40 keys of 128 points, 512 a task
    got = {r.k: r.kl for r in found.collect()}
    assert got.keys() == data.keys()
    for k, x in data.items():
        h = len(x) ** -0.2 * x.std(ddof=1)
        g, dx = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 128, retstep=True)
        p = np.maximum(np.exp(-0.5 * ((g[:, None] - x) / h) ** 2).mean(axis=1) / (h * np.sqrt(2 * np.pi)), 1e-12)
        q = np.maximum(np.exp(-0.5 * (g - x.mean()) ** 2 / x.var()) / np.sqrt(2 * np.pi * x.var()), 1e-12)
        assert abs(got[k] - (p * np.log(p / q)).sum() * dx) < 1e-9

from pyspark.sql import functions as F

from tracewell.operators import graph, reaching


def closure(ways, start):
    seen, front, hop = {start: 0}, {start}, 0
    while front:
        hop += 1
        front = {y for x in front for y in ways.get(x, ())} - seen.keys()
        seen |= dict.fromkeys(front, hop)
    return seen


def test_many_seeds_in_few_rows(spark, monkeypatch):
    """1,100 seeds through a hub: pairs are never written, nulls and groups are kept apart."""
    rows = [(1, i, 5000) for i in range(1100)] + [(1, 5000, 6000 + i) for i in range(40)] + [(1, 5000, None), (1, 6000, 3), (2, 7, 8), (None, 9, 9)]
    e = spark.createDataFrame(rows, "day int, src long, dst long")
    stored, real = [], reaching.written
    for module in (graph, reaching):
        monkeypatch.setattr(module, "written", lambda df, label: stored.append(real(df, label)) or stored[-1])
    got = sorted(map(tuple, graph.reach(e, e.select("day", F.col("src").alias("node")), "day").collect()), key=str)
    assert sum(t.count() for t in stored) < 10_000
    want = [(None, 9, 9, 0)]
    for day in (1, 2):
        ways = {}
        for _, s, t in (r for r in rows if r[0] == day):
            ways.setdefault(s, []).append(t)
        want += [(day, s, n, h) for s in ways for n, h in closure(ways, s).items()]
    assert got == sorted(want, key=str) and len(want) > 45_000


def test_seeds_of_several_nodes(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(10)], "src long, dst long")
    seeds = spark.createDataFrame([("a", 2), ("a", 6), ("b", 9)], "seed string, node long")
    got = {(r.seed, r.node): r.hops for r in graph.reach(e, seeds).collect()}
    assert got == {("a", n): (n - 6 if n > 5 else n - 2) for n in range(2, 11)} | {("b", 9): 0, ("b", 10): 1}


def test_ways_are_ranked_without_their_nodes(spark, monkeypatch):
    """70 entries, a cycle of 12 and 70 points: 68,600 triples stand behind pairs, and no table holds them."""
    n = 12
    edges = [(100 + i, 0) for i in range(70)] + [(i, (i + 1) % n) for i in range(n)] + [(5, 200 + i) for i in range(70)]
    e = spark.createDataFrame(edges, "src long, dst long").withColumn("day", F.lit(1))
    pois = spark.range(200, 270).select(F.lit(1).alias("day"), F.col("id").alias("node"))
    scores = spark.range(300).select(F.lit(1).alias("day"), F.col("id").alias("node"), F.when(F.col("id").isin(103, 110), 8.0).otherwise(1.0).alias("score"))
    stored, real = [], reaching.written
    for module in (graph, reaching):
        monkeypatch.setattr(module, "written", lambda df, label: stored.append(real(df, label)) or stored[-1])
    parts = graph.entry_components(e, pois, "day")
    assert parts.count() == 70 * 70 * (n + 2)
    got = {(r.poi, r.node) for r in graph.ranked_ways(e, pois, scores, "day").collect()}
    assert got == {(p, x) for p in range(200, 270) for x in [*range(n), 103, 110, p]}
    assert {tuple(r) for r in graph.ranked_entries(parts, scores, "day").collect()} == {(1, *x) for x in got}
    assert sum(t.count() for t in stored) < 5_000


def test_pseudo_graph_by_bits(spark):
    """Roots that reach more than half of the nodes go, by counts of bits."""
    rows = [(1, i, 100 + i % 3, i) for i in range(70)] + [(1, 200, 100 + i, 500 + i) for i in range(90)] + [(2, 1, 2, 0), (2, 2, 3, 1)]
    e = spark.createDataFrame(rows, "day int, src long, dst long, t long")
    ways, first, into = {}, {}, {}
    for day, s, d, t in rows:
        ways.setdefault((day, s), []).append((day, d))
        first[day, s] = min(t, first.get((day, s), t))
        into[day, d] = min(t, into.get((day, d), t))
    nodes = set(first) | set(into)
    down = {x: closure(ways, x).keys() - {x} for x in first if x not in into or first[x] < into[x]}
    want = {(x[0], x[1], y[1]) for x, ys in down.items() if len(ys) <= 0.5 * sum(z[0] == x[0] for z in nodes) for y in ys}
    assert {tuple(r) for r in graph.pseudo_graph(e, 0.5, "day").collect()} == want and len({x for _, x, _ in want}) < len(down)


def test_words_stand_for_classes(spark, monkeypatch):
    """1,500 seeds to one of 3 hubs, 1,500 nodes from one: words are kept for classes of seeds and nodes, however many members they have; cycles, loops, nulls and a bound of hops as before."""
    rows = [(1, i, 5000 + i % 3) for i in range(1500)] + [(1, 5000 + i % 3, 6000 + i) for i in range(1500)] + [(1, 5000, 5001), (1, 6000, 7), (1, 8, 8), (1, 5001, None), (2, 1, 2), (2, 2, 1)]
    e = spark.createDataFrame(rows, "day int, src long, dst long")
    stored, real = {}, reaching.written
    for module in (graph, reaching):
        monkeypatch.setattr(module, "written", lambda df, label: stored.setdefault(label, []).append(real(df, label)) or stored[label][-1])
    nodes = e.select("day", F.explode(F.array("src", "dst")).alias("node")).distinct()
    for backward, most in ((False, None), (True, 2)):
        found = graph.reach(e, nodes, "day", backward=backward, max_hops=most)
        got = sorted(map(tuple, found.collect()), key=str)
        want = [(1, None, None, 0)]
        for day in (1, 2):
            ways = {}
            for _, s, t in (r for r in rows if r[0] == day):
                a, b = (t, s) if backward else (s, t)
                ways.setdefault(a, []).append(b) if a is not None else None
            ends = {x for r in rows if r[0] == day for x in r[1:]} - {None}
            want += [(day, s, n, h) for s in ends for n, h in closure(ways, s).items() if most is None or h <= most]
        assert got == sorted(want, key=str) and len(want) > 500_000
    assert sum(t.count() for t in stored["reached"]) < 200


def test_pseudo_graph_by_classes(spark, monkeypatch):
    """300 roots, 3 hubs, 300 nodes behind them: what is counted and dropped are classes."""
    rows = [(1, i, 5000 + i % 3, 1) for i in range(300)] + [(1, 5000 + i % 3, 6000 + i, 2) for i in range(300)]
    e = spark.createDataFrame(rows, "day int, src long, dst long, t long")
    stored, real = [], graph.written
    for module in (graph, reaching):
        monkeypatch.setattr(module, "written", lambda df, label: stored.append((label, real(df, label))) or stored[-1][1])
    got = {(r.root, r.node) for r in graph.pseudo_graph(e, 0.5, "day").collect()}
    assert got == {(i, x) for i in range(300) for x in [5000 + i % 3, *range(6000 + i % 3, 6300, 3)]}
    assert sum(t.count() for label, t in stored if label in ("reached", "cells")) < 50

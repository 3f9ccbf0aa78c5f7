"""Walks and memories against plain Python, with a hub that holds a third of all edges, dead ends, self loops, ties and nulls."""

import hashlib
import math
import random
import time
from collections import defaultdict

from tracewell.operators import graph, memory, storage, summaries, walking, windows
from tracewell.streaming import events as streams

SCHEMA = "src long, dst long, op string, t long, event_uuid long"


def draw(seed, *of):
    return int(hashlib.md5("|".join(map(str, (seed, *of))).encode()).hexdigest()[:15], 16)


def some_edges(n=300, seed=1):
    """Node 0 is an end of a third of the edges; times repeat; 50 to 54 have no outgoing edge."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = (0, r.randrange(55)) if i % 6 == 0 else (r.randrange(50), 0) if i % 6 == 1 else (r.randrange(50), r.randrange(55))
        rows.append((a, b, r.choice("RWX"), r.randrange(n // 2), i))
    return rows


def walked(rows, length, per_node, temporal):
    out = defaultdict(list)
    for s, d, op, t, e in sorted(rows, key=lambda x: (x[3], x[4])):
        out[s].append((t, d, op))
    found = set()
    for start in out:
        for walk in range(per_node):
            node, t = start, None
            found.add((walk, start, 0, node, None))
            for step in range(1, length):
                open_ = [x for x in out.get(node, []) if not temporal or t is None or x[0] > t]
                if not open_:
                    break
                t, node, op = open_[draw(0, start, walk, step) % len(open_)]
                found.add((walk, start, step, node, op))
    return found


def test_walks(spark):
    rows = some_edges()
    edges = spark.createDataFrame([*rows, (None, 3, "R", 5, 900), (3, None, "R", 5, 901)], SCHEMA)
    for temporal in (False, True):
        got = walking.walks(edges, 5, 3, temporal=temporal).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == walked(rows, 5, 3, temporal)
    again = walking.walks(edges.repartition(7), 5, 3, temporal=True)
    assert {tuple(r) for r in again.collect()} == walked(rows, 5, 3, True)
    assert walking.walks(edges.limit(0), 4, 2).count() == 0


def test_temporal_walks_go_back_from_sinks(spark):
    edges = spark.createDataFrame([(1, 2, "R", 1, 0), (2, 9, "W", 5, 1), (3, 2, "R", 7, 2)], SCHEMA)
    got = {(r.start, r.step, r.node) for r in walking.temporal_walks(edges, 4, 1).collect()}
    assert {x for x in got if x[0] == 9} == {(9, 0, 9), (9, -1, 2), (9, -2, 1)}  # not 3: that edge came later
    assert {x for x in got if x[0] == 3} == {(3, 0, 3), (3, 1, 2)}


def test_degree_walks(spark):
    rows = some_edges()
    near = defaultdict(lambda: defaultdict(set))
    for s, d, op, _, _ in rows:
        near[s][d].add(op)
    want = set()
    for start in near:
        for walk in range(2 * len(near[start])):
            node = start
            want.add((start, walk, 0, node, None))
            for step in range(1, 5):
                if node not in near:
                    break
                next_ = sorted(near[node])[draw(0, start, walk, step) % len(near[node])]
                ops = sorted(near[node][next_])
                node = next_
                want.add((start, walk, step, node, ops[draw(1, start, walk, step) % len(ops)]))
    got = walking.degree_walks(spark.createDataFrame([*rows, (None, 1, "R", 1, 900), (1, 2, None, 1, 901)], SCHEMA), 4, 2).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def rings(batches, size, hops, with_batch):
    """What a loader that keeps a ring of neighbours for each node returns, batch by batch."""
    ring, found = defaultdict(list), set()
    for b in sorted({x[5] for x in batches}):
        mine = sorted((x for x in batches if x[5] == b), key=lambda x: (x[3], x[4]))
        def insert():
            for s, d, _, _, e, _ in mine:
                for node, other in sorted([(s, d), (d, s)], key=lambda p: p[1]):
                    ring[node].append((other, e))
        if with_batch:
            insert()
        asked, front = set(), {n for x in mine for n in x[:2]}
        for hop in range(1, hops + 1):
            asked |= front
            met = {(b, hop, n, other, e) for n in front for other, e in ring[n][-size:]}
            found |= met
            front = {x[3] for x in met} - asked
        if not with_batch:
            insert()
    return found


def test_hop_neighbours(spark):
    rows = [(*x, x[3] // 10) for x in some_edges() if x[0] != x[1]]
    edges = spark.createDataFrame([*rows, (None, 3, "R", 5, 900, 1), (3, 4, "R", 5, 901, None)], SCHEMA + ", batch long")
    for with_batch in (False, True):
        for hops in (1, 3):
            got = memory.hop_neighbours(edges, 3, hops, with_batch).collect()
            assert len(got) == len(set(got)) and {tuple(r) for r in got} == rings(rows, 3, hops, with_batch)
    assert memory.hop_neighbours(edges.limit(0), 3, 2).count() == 0


def stores(batches):
    held, found = {}, {}
    for b in sorted({x[5] for x in batches}):
        mine = [x for x in batches if x[5] == b]
        fresh = defaultdict(list)
        for x in mine:
            fresh[x[0], 0].append((x[3], x[4], x[6]))
            fresh[x[1], 1].append((x[3], x[4], x[6]))
        for node in {k[0] for k in fresh}:
            own = [held.get((node, i)) for i in range(2)]
            parts = []
            for m in own:
                x = [v for _, _, v in m if v is not None] if m else []
                parts += [len(m) if m else 0, round(sum(x) / len(x), 9) if x else None, max(m)[2] if m else None]
            found[b, node] = (max((max(m)[0] for m in own if m), default=None), *parts)
        held.update(fresh)
    return found


def test_message_stores_in_batches_and_streams(spark, tmp_path):
    rows = [(*x, x[3] // 10, None if x[4] % 11 == 0 else float(x[4] % 17)) for x in some_edges(240)]
    edges = spark.createDataFrame([*rows, (None, 3, "R", 5, 900, 1, 1.0)], SCHEMA + ", batch long, value double")
    names = ["last_update", *(f"{s}_{c}" for s in ("sent", "got") for c in ("n", "mean", "last"))]
    plain = lambda r: tuple(round(r[n], 9) if n.endswith("mean") and r[n] is not None else r[n] for n in names)
    want = stores(rows)
    got = {(r.batch, r.node): plain(r) for r in memory.stored_messages(edges, "value").collect()}
    assert got == want
    for b in sorted({x[5] for x in rows})[:5]:
        edges.where(f"batch = {b}").drop("batch").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(edges.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.message_stores(stream, "value").writeStream.format("memory").queryName("stores").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    found = sorted(((r.node, plain(r)) for r in spark.table("stores").collect()), key=repr)
    first = sorted({x[5] for x in rows})[:5]
    assert found == sorted(((node, v) for (b, node), v in want.items() if b in first), key=repr)


def test_closure_in_components(spark):
    rows = [(g, 10 * k + i, 10 * k + (i + 1) % 4) for g in (1, 2) for k in range(3) for i in range(4)] + [(1, 0, 10), (1, 11, 25), (2, 20, 0), (2, 7, 7), (1, 30, 0)]
    edges = spark.createDataFrame([*rows, (None, 1, 2), (1, None, 2)], "g int, src long, dst long")
    members, reached = graph.closure(edges, "g")
    of = {(r.g, r.node): r.component for r in members.collect()}
    nodes = {(g, n) for g, *ends in rows for n in ends}
    assert set(of) == nodes and of[1, 13] == 10 and of[2, 7] == 7 and of[1, 25] == 25
    to = defaultdict(set)
    for g, s, d in rows:
        to[g, s].add(d)
    want = set()
    for g, n in nodes:
        seen, front = {n}, {n}
        while front:
            front = {d for x in front for d in to[g, x]} - seen
            seen |= front
        want |= {(g, n, x) for x in seen}
    pairs = {(r.g, r.component, r.reached) for r in reached.collect()}
    got = {(g, n, x) for g, n in nodes for h, x in nodes if g == h and (of[g, n] == of[g, x] or (g, of[g, n], of[g, x]) in pairs)}
    assert got == want


def test_pair_graphs(spark):
    edges = spark.createDataFrame([(1, 0, 1, 2, "R", 5, 0), (1, 0, 1, 2, "W", 4, 1), (1, 1, 1, 2, "X", 9, 2), (1, 1, 3, 3, "X", 9, 3), (2, 0, 1, 2, "X", 1, 4)], "day int, tw int, " + SCHEMA)
    assert sorted(map(tuple, windows.pair_graphs(edges, "day", "tw").collect())) == [(1, 0, 1, 2, "W", 2), (1, 1, 1, 2, "X", 1), (1, 1, 3, 3, "X", 1), (2, 0, 1, 2, "X", 1)]
    day = [(1, t, *x) for t in (0, 1) for x in ((1, 2, "W", 3), (3, 3, "X", 1))]
    assert sorted(map(tuple, windows.pair_graphs(edges, "day", "tw", whole_day="day").collect())) == [*day, (2, 0, 1, 2, "X", 1)]


def test_drift_and_martingale_with_a_hot_key(spark):
    r = random.Random(5)
    rows = [(r.choice("aaab"), float(r.randrange(20)), i) for i in range(400)] + [("c", 1.0, 900)]
    table = spark.createDataFrame(rows, "k string, x double, i int")
    got = {x.k: round(x.ks, 9) for x in summaries.ks_drift(table.where("i < 250"), table.where("i >= 250"), "x", "k").collect()}
    want = {}
    for k in "ab":
        a, b = ([x for kk, x, i in rows if kk == k and (i < 250) == side] for side in (True, False))
        want[k] = round(max(abs(sum(v <= t for v in a) / len(a) - sum(v <= t for v in b) / len(b)) for t in a + b), 9)
    assert got == want  # c has nothing before, so no distance
    hits = table.selectExpr("k", "i as event_uuid", "i as t", "cast(x > 15 as int) as hit")
    m = {x.event_uuid: x.m for x in summaries.martingale(hits, 0.2, 0.5, "k").collect()}
    n, s = defaultdict(int), defaultdict(int)
    for k, x, i in rows:
        n[k], s[k] = n[k] + 1, s[k] + (x > 15)
        assert math.isclose(m[i], math.exp(0.5 * s[k] - n[k] * math.log(1 - 0.2 + 0.2 * math.exp(0.5))), rel_tol=1e-9)


def test_walkers_are_not_broadcast(spark, monkeypatch):
    """Files of walkers are small for their rows, so a step sorts and shuffles them whatever Spark makes of the bytes; so do tables over the bound of rows."""
    plans, write = [], walking.written

    def kept(table, label):
        plans.append((label, table._jdf.queryExecution().executedPlan().toString()))
        return write(table, label)

    monkeypatch.setattr(walking, "written", kept)
    edges = spark.createDataFrame(some_edges(60), SCHEMA)
    walking.degree_walks(edges, 2, 2)
    walking.walks(edges, 2, 2)
    steps = [plan for label, plan in plans if label == "walks" and "md5" in plan]
    assert len(steps) == 3 and all("SortMergeJoin [node" in plan for plan in steps)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 10)
    many = storage.written(spark.range(20), "many")
    assert "Broadcast" not in spark.range(5).join(storage.bounded(many), "id")._jdf.queryExecution().executedPlan().toString()

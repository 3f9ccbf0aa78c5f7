"""Traces, components, queues and batches against brute force."""

import random
from collections import defaultdict, deque

from tracewell.operators import graph, queues, reaching, tracing, windows


def edges(spark, seed, nodes=9, n=40):
    r = random.Random(seed)
    rows = [(r.randrange(nodes), r.randrange(nodes), r.choice((5, 7, 11, r.randrange(100))), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "src long, dst long, t long, event_uuid long")


def all_paths(rows, point, backward):
    """Every path listed, one by one."""
    adj = defaultdict(lambda: defaultdict(list))
    for s, d, t, _ in rows:
        if backward:
            adj[d][s].append(t)
        else:
            adj[s][d].append(-t)
    found, queue = defaultdict(set), deque([(point, float("inf"), ())])
    while queue:
        node, time, path = queue.popleft()
        ends = True
        for other, times in adj[node].items():
            before = [t for t in times if t < time]
            if before:
                ends = False
                queue.append((other, max(before), (*path, (other, node) if backward else (node, other))))
        if ends:
            found[node] |= set(path)
    return found


def test_temporal_paths(spark, monkeypatch):
    monkeypatch.setattr(tracing, "CHUNK", 2)
    for seed in (1, 2):
        rows, df = edges(spark, seed)
        points = spark.createDataFrame([(0,), (3,), (77,)], "node long")
        for backward in (True, False):
            got = defaultdict(set)
            for r in tracing.temporal_paths(df, points, backward=backward).collect():
                got[r.poi, r.entry] |= {(r.src, r.dst)} - {(None, None)}
            want = {(p, e): s for p in (0, 3, 77) for e, s in all_paths(rows, p, backward).items()}
            assert dict(got) == want and len({e for _, e in want}) > 3


def test_shortest_paths(spark):
    rows, df = edges(spark, 5, 12, 16)
    for backward in (True, False):
        got = {(r.poi, r.entry): r.path for r in tracing.shortest(df, spark.createDataFrame([(0,), (4,)], "node long"), backward=backward).collect()}
        step = defaultdict(set)
        for s, d, *_ in rows:
            if s != d:
                step[d if backward else s].add(s if backward else d)
        want = {}
        for poi in (0, 4):
            hops, queue = {poi: 0}, deque([poi])
            while queue:
                x = queue.popleft()
                for y in step[x] - hops.keys():
                    hops[y] = hops[x] + 1
                    queue.append(y)
            want |= {(poi, e): h for e, h in hops.items() if e != poi and not step[e] & hops.keys()}
        assert {k: len(p) - 1 for k, p in got.items()} == want
        pairs = {(s, d) for s, d, *_ in rows}
        assert all((a, b) in pairs for p in got.values() for a, b in zip(p, p[1:]))


def test_strong_components(spark):
    for seed, n in ((3, 14), (4, 25), (8, 60)):
        rows, df = edges(spark, seed, 14, n)
        out = defaultdict(set)
        for s, d, *_ in rows:
            out[s].add(d)

        def reach(a, out=out):
            seen, todo = set(), [a]
            while todo:
                for y in out[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            return seen

        far = {a: reach(a) for a in range(14)}
        same = {a: {b for b in far[a] if a in far[b] or a == b} | {a} for a in far}
        got = {r.node: r.component for r in graph.strong_components(df).collect()}
        assert got == {a: min(s) for a, s in same.items() if len(s) > 1}
        assert {(r.src, r.dst) for r in graph.acyclic(df).collect()} == {(s, d) for s, d, *_ in rows if s != d and d not in same[s]}
    assert graph.strong_components(df.where("false")).collect() == []


def test_queues_and_chains(spark):
    r = random.Random(1)
    members = {(w, r.randrange(30)) for w in range(40) for _ in range(r.randrange(3))} | {(w, 99) for w in range(5, 12)}
    df = spark.createDataFrame(sorted(members), "tw long, node long")
    rare = spark.createDataFrame([(n,) for n in (*range(12), 99)], "node long")
    of = {}
    for w in sorted({w for w, _ in members}):
        own = {n for x, n in members if x == w and (n < 12 or n == 99)}
        known = [of[o] for o in of if own & {n for x, n in members if x == o and (n < 12 or n == 99)}]
        of[w] = min(known) if known else w
    number = {f: i for i, f in enumerate(sorted(set(of.values())))}
    want = {w: number[f] for w, f in of.items()}
    for related in (queues.related_windows(df, rare), queues.chained_windows(df, rare)):
        assert {x.tw: x.queue for x in queues.queues(df, related).collect()} == want


def test_pair_batches(spark):
    r = random.Random(2)
    rows = [(i % 3, r.randrange(4), r.randrange(4), r.randrange(50), i) for i in range(300)] + [(7, 1, 1, i, 1000 + i) for i in range(70)] + [(8, 0, 0, 0, 5000)]
    df = spark.createDataFrame(rows, "day int, src long, dst long, t long, event_uuid long")
    want = {}
    for day in {x[0] for x in rows}:
        seen, batch = set(), 0
        for _, s, d, _, e in sorted((x for x in rows if x[0] == day), key=lambda x: (x[3], x[4])):
            if (s, d) in seen:
                seen, batch = set(), batch + 1
            seen.add((s, d))
            want[e] = batch
    got = windows.pair_batches(df, "day")
    assert {x.event_uuid: x.batch for x in got.collect()} == want and got.columns == [*df.columns, "batch"]


def test_shortest_paths_write_no_pairs(spark, monkeypatch):
    """300 entries lead through one hub to 100 points: 30,000 paths, made as they are read."""
    rows = [(1000 + i, 500) for i in range(300)] + [(500, i) for i in range(100)]
    df, sizes, write = spark.createDataFrame(rows, "src long, dst long"), [], tracing.written

    def counted(table, label):
        out = write(table, label)
        sizes.append(out.count())
        return out

    for module in (tracing, reaching):
        monkeypatch.setattr(module, "written", counted)
    got = tracing.shortest(df, spark.createDataFrame([(i,) for i in range(100)], "node long"))
    assert {(r.poi, r.entry, tuple(r.path)) for r in got.collect()} == {(p, e, (e, 500, p)) for p in range(100) for e in range(1000, 1300)}
    assert max(sizes) <= 400


def test_temporal_trace_by_chunks(spark, monkeypatch):
    """Steps read one chunk of a node's edges, with ties at the ends of chunks and many seeds at one place."""
    monkeypatch.setattr(graph, "CHUNK", 2)
    r = random.Random(3)
    rows = sorted({(r.randrange(5), r.randrange(5), r.randrange(12)) for _ in range(60)})
    df = spark.createDataFrame(rows, "src long, dst long, t long")
    seeds = spark.createDataFrame([(n, t) for n, t in ((0, 9), (1, 12), (2, 5), (3, 0), (4, 3), (77, 5))], "node long, t long")
    for backward in (True, False):
        want = set()
        for seed, t in ((0, 9), (1, 12), (2, 5), (3, 0), (4, 3), (77, 5)):
            node, hop = seed, 0
            while node is not None:
                want.add((seed, hop, node, t))
                near = [(x, s) for s, d, x in rows if d == node and x < t] if backward else [(x, d) for s, d, x in rows if s == node and x > t]
                (t, node), hop = (max(near) if backward else min(near)) if near else (None, None), hop + 1
        assert {tuple(x) for x in graph.temporal_trace(df, seeds, backward).select("seed", "hop", "node", "t").collect()} == want


def test_temporal_paths_shuffle_no_pairs(spark, monkeypatch):
    """70 entries lead through one node, at two times, to 70 points: pairs of point and entry are made as they are read, and a hop writes two tables."""
    rows = [(1000 + i, 500, t) for i in range(70) for t in (1, 3)] + [(500, 600, 2)] + [(m, i, t) for i in range(70) for m, t in ((500, 4), (600, 3))]
    rows += [(2000 + i, 2001 + i, i) for i in range(6)]
    df, tables, write = spark.createDataFrame(rows, "src long, dst long, t long"), [], tracing.written
    for module in (tracing, reaching):
        monkeypatch.setattr(module, "written", lambda table, label: tables.append(label) or write(table, label))
    got = tracing.temporal_paths(df, spark.createDataFrame([(i,) for i in (*range(70), 2006)], "node long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(poi" not in plan and "hashpartitioning(a#" in plan
    assert len(tables) < 7 * 2 + 14
    ways = [(p, e, *x) for p in range(70) for e in range(1000, 1070) for x in ((e, 500), (500, p), (500, 600), (600, p))]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {*ways, *((2006, 2000, 2000 + i, 2001 + i) for i in range(6))}


def test_component_rounds_read_their_tables_once(spark, monkeypatch):
    rows = [(g, 10 * k + i, 10 * k + (i + 1) % 4) for g in (1, 2) for k in range(3) for i in range(4)] + [(1, 0, 10), (1, 11, 25), (2, 20, 0), (2, 7, 7), (1, 30, 0)]
    leaves, whole = defaultdict(int), graph.written

    def counted(df, label):
        leaves[label] = max(leaves[label], df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return whole(df, label)

    monkeypatch.setattr(graph, "written", counted)
    found, _ = graph.condensed(spark.createDataFrame(rows, "g int, src long, dst long"), "g")
    of = {(r.g, r.node): r.component for r in found.collect()}
    want = {(g, n): n // 10 * 10 if n % 10 < 4 and n != 30 else n for g, *ends in rows for n in ends}
    assert of == want
    assert leaves["core"] <= 4 and leaves["colours"] <= 12  # three rounds in one plan read theirs many times over

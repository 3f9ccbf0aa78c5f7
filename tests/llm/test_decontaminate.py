import hashlib
import re

from tracewell.llm import decontaminate as m


def toks(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(rows, items):
    wins = {}
    for i, t in items:
        w = toks(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, ids = toks(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if k := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= k
        names = ",".join(sorted(map(str, ids)))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def brute_near(rows, items, slack):
    """The items with a window whose words occur in order with at most slack words between."""
    out = {}
    for n, (_, t) in enumerate(rows):
        w, found = toks(t), set()
        for i, x in items:
            x = toks(x)
            size = min(13, len(x))
            for s in range(len(x) - size + 1 if x else 0):
                at = {p for p, y in enumerate(w) if y == x[s]}
                for word in x[s + 1 : s + size]:
                    at = {q for p in at for q in range(p + 1, p + 2 + slack) if q < len(w) and w[q] == word}
                if at:
                    found.add(i)
        out[n] = len(found - {None})
    return out


def test_contamination_against_brute_force(docs, spark, text):
    items = [(1, text(1, 20)), (2, text(2, 13)), (12, text(2, 13).upper()), (3, "Short Item"), (4, None), (5, " ,. "), (6, text(6, 40)), (7, "ha " * 15), (7, "other text under one id"), (8, "É accented été words"), (None, "null item phrase")]
    rows = [
        (0, text(100, 50)), (1, text(100, 30) + " " + text(1, 20) + " " + text(101, 30)), (2, text(1, 20)[:-1]), (3, "a short ITEM, and a short-item!"), (4, None), (5, ""), (6, text(102, 2000) + " " + text(6, 40)),
        (7, "ha " * 100), (8, "\u00e9 accented \u00e9t\u00e9 words; \u00c9 ACCENTED \u00e9t\u00e9 WORDS"), (9, text(2, 13)), (9, text(2, 13)), (10, " ".join(toks(text(1, 20))[:13])), (11, " ".join(toks(text(1, 20))[:12])), (None, text(2, 13)), (13, "null item phrase"),
        (14, " ".join(toks(text(1, 20))[:10] + ["gap"] + toks(text(1, 20))[10:])), (15, text(6, 40) + " " + text(1, 20)),
    ]
    table = docs([(i, t, "en", "s") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in m.contamination(table, bench).collect()), key=str)
    want = [(d, n, h, k - (0 if d is None else 0), s, c) for d, n, h, k, s, c in brute(rows, [(i, t) for i, t in items if i is not None])]
    # a null item is found but has no name and isn't counted
    assert [g for g in got if g[0] != 13] == [w for w in want if w[0] != 13]
    assert [g[:4] for g in got if g[0] == 13] == [(13, 3, 3, 0)]
    near = m.contamination(table, bench, slack=2)
    counted = brute_near(rows, items, 2)
    assert sorted((str(r.doc_id), r.n_hit, r.n_near) for r in near.collect()) == sorted((str(d), next(g[2] for g in got if g[:2] == (d, len(toks(t)))), counted[n]) for n, (d, t) in enumerate(rows))
    assert counted[15] == 1  # one word between
    kept = m.decontaminate(table, bench)
    gone = {g[0] for g in got if g[5]}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in rows if i not in gone), key=str)
    assert kept.columns == table.columns


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert m.contamination(docs([]), none).count() == 0
    assert [tuple(r)[:3] for r in m.contamination(docs([(1, "some words", "en", "s")]), none).collect()] == [(1, 2, 0)]


def test_proximity(docs, spark):
    terms = m.item_terms(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    index = m.build_index(docs([(1, "x alpha y beta gamma", "en", "s"), (2, "gamma beta alpha", "en", "s"), (3, "alpha beta z z z gamma", "en", "s")]), terms)
    owner = {r.row: r.doc_id for r in index.where("tid = 0").collect()}
    near = {(owner[r.row], r.start, r.stop) for r in m.proximity(index, terms, 1).collect()}
    assert near == {(1, 1, 5)}
    assert {owner[r.row] for r in m.proximity(index, terms, 3).collect()} == {1, 3}


def test_proximity_by_every_posting(docs, spark, text):
    """A chain goes through any posting within reach, not only the nearest; all of them against brute force."""
    items = [(1, "alpha beta gamma"), (2, text(3, 20)), (3, "ha ha ho")]
    words = toks(text(3, 20))
    gaps = " ".join(w + (" x" if i % 3 == 0 else " x y" if i % 5 == 0 else "") for i, w in enumerate(words))
    rows = [(1, "alpha beta x beta y z gamma"), (2, gaps), (3, "ha ha ha ho ha ho ho"), (4, text(9, 50) + " " + gaps.replace(" x", " x x x x")), (5, None), (6, "gamma beta alpha"), (7, " ".join(words[::-1]))]
    terms = m.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    index = m.build_index(docs([(i, t, "en", "s") for i, t in rows]), terms)
    owner = {r.row: r.doc_id for r in index.where("tid = 0").collect()}
    got = {(owner[r.row], r.item_id, r.start, r.stop) for r in m.proximity(index, terms, 2).collect()}
    want = set()
    for d, t in rows:
        w = toks(t)
        for i, x in items:
            x = toks(x)
            size = min(13, len(x))
            for s in range(len(x) - size + 1):
                for p in (p for p, y in enumerate(w) if y == x[s]):
                    at = {p}
                    for word in x[s + 1 : s + size]:
                        at = {r for q in at for r in range(q + 1, q + 4) if r < len(w) and w[r] == word}
                    if at:
                        want.add((d, i, p, min(at) + 1))
    assert (1, 1, 0, 7) in want and got == want


def test_look_ups_pass_over_the_longest_lists(docs, spark):
    assert m.stretches([(1, 100, False), (2, 5, True), (3, 50, False), (4, 1, True), (5, 1, False), (6, 1, True)], 2) == [(2, 2), (4, 6)]
    assert m.stretches([(1, 1, False)]) == [] and m.stretches([(1, 1, True)]) == [(1, 1)]
    terms = m.item_terms(spark.createDataFrame([(1, "common rare"), (2, "common other")], "item_id long, text string"))
    index = m.build_index(docs([(i, "common common common rare" if i == 3 else "common other", "en", "s") for i in range(50)]), terms)
    wanted = terms.where("term = 'rare'").select("tid")
    found = m.look_up(index, m.list_sizes(index), wanted)
    assert found.count() == 1 and "PushedFilters: [" in found._jdf.queryExecution().executedPlan().toString()

import zlib

import numpy as np
import pytest

from tracewell.llm import language, markov, mixing, urls


def direct_bits(counts, order, blend, data, label):
    """Code length by the definition, one byte at a time."""
    per = {}
    for lab, gram, n in counts:
        if lab == label:
            g = int(np.uint64(np.int64(gram)))
            for k in range(order + 1):
                low = g & ((1 << 8 * (k + 1)) - 1)
                ctx = per.setdefault((k, low >> 8), {})
                ctx[low & 255] = ctx.get(low & 255, 0) + n
    whole = b" " * order + data
    total = 0.0
    for i in range(order, len(whole)):
        if blend:
            p = 2.0**-8
            for k in range(order + 1):
                if ctx := per.get((k, int.from_bytes(whole[i - k : i], "big"))):
                    n, q = sum(ctx.values()), len(ctx)
                    p = (ctx.get(whole[i], 0) + q * p) / (n + q)
            total -= np.log2(p)
            continue
        for k in range(order, -1, -1):
            if ctx := per.get((k, int.from_bytes(whole[i - k : i], "big"))):
                n, q = sum(ctx.values()), len(ctx)
                if whole[i] in ctx:
                    total -= np.log2(ctx[whole[i]] / (n + q))
                    break
                total -= np.log2(q / (n + q))
        else:
            total += 8
    return total


@pytest.mark.parametrize("blend", [False, True])
def test_tables_give_the_defined_code_lengths(spark, blend):
    rows = [("x", "abracadabra abra"), ("x", "barbara"), ("y", "mississippi ships"), ("y", "\u00e9t\u00e9 \u00e9")]
    counts = markov.gram_counts(spark.createDataFrame(rows, "label string, text string"), 3, str.encode).toPandas()
    trees = markov.Trees(counts, 3, blend)
    data = [b"abra ship", "zz\u00e9t\u00e9 barb".encode(), b"q", b""]
    got = trees.lengths(data)
    for i, d in enumerate(data):
        for j, label in enumerate(trees.labels):
            assert got[i, j] == pytest.approx(direct_bits(list(counts.itertuples(index=False)), 3, blend, d, label), rel=1e-4, abs=1e-4)


def test_long_texts_in_pieces(spark, monkeypatch):
    counts = markov.gram_counts(spark.createDataFrame([("x", "abc abd " * 50)], "label string, text string"), 4, str.encode).toPandas()
    trees = markov.Trees(counts, 4)
    one = trees.lengths([b"abc abd abq " * 500, b"abd"])
    monkeypatch.setattr(markov, "PIECE", 64)
    assert np.allclose(one, trees.lengths([b"abc abd abq " * 500, b"abd"]), rtol=1e-5)


def test_language_held_out(docs):
    words = {"aa": ["kala", "mato", "vesi", "kukka"], "bb": ["schrift", "stern", "berg", "wolke"], "cc": ["\u00e9t\u00e9", "o\u00f9", "gar\u00e7on", "for\u00eat"]}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[g], 40)), g, "s") for i in range(300) for g in [["aa", "bb", "cc"][i % 3]]]
    odd = [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "123 \u00b2 !?", "aa", "s"), (903, "KALA " * 50_000, None, None), (905, "KALA" * 50_000, None, None), (None, "stern berg", None, "s"), (1, rows[1][1], "bb", "s"), (904, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0", None, "s")]
    table = docs(rows + odd)
    trees = language.train(table)
    assert trees.labels == ["aa", "bb", "cc"]
    got = language.identify(table, trees).withColumn("held", language.held_out()).collect()
    label = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows + odd)
    for r in got:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.lang_pred == label[r.doc_id] and 0 < r.score <= 1
            assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0 and by[903].lang_pred == "aa" and by[None].lang_pred == "bb"
    kept = language.keep_identified(table, trees)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows + odd} - {900, 901, 902, 904, 905}
    nothing = language.train(docs([]))
    assert nothing is None and [r.lang_pred for r in language.identify(table, nothing).limit(2).collect()] == ["und"] * 2


def test_training_ignores_held_out_rows(docs):
    rows = [(i, "plain words here", "aa", "s") if zlib.crc32(str(i).encode()) % 4 != 2 else (i, "qqqq zzzz", "bb", "s") for i in range(40)]
    assert language.train(docs(rows)).labels == ["aa"]


def brute_targets(sizes):
    """The contract's resharing loop."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap, left, free, out = {s: 2 * sizes[s] for s in names}, 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(cap[s])
            left -= cap[s]
        free -= over


def test_mix(docs, text):
    rows = [(i, text(i, 20 + (i * 37) % 300), "en", ["a", "b", "c", "\u00e9", None][min(i % 7, 4)]) for i in range(400)]
    rows += [(1000, None, None, "a"), (1001, "", "en", "b"), (1002, "  \n", "en", "z"), (1003, "w " * 20_000, "en", "c"), (5, rows[5][1], "en", rows[5][3]), (None, "one two", "en", "a")]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9) and r.taken == r.copies * r.size <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert n == pytest.approx(want[s], rel=0.03, abs=30)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(rows).repartition(3)).collect()))
    table = docs(rows)
    copies = mixing.mixture(table)
    assert set(copies.columns) == set(table.columns)
    n = {}
    for r in copies.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert all(n.get(r.doc_id, 0) == r.copies for r in got if r.doc_id not in (5, None))
    assert mixing.mix(docs([])).count() == 0 and mixing.mix(docs([(1, None, "en", None)])).collect()[0].taken == 0


def test_mix_swaps_large_documents(spark, docs):
    """Sources of few and large documents come near their targets too, or say that they can't."""
    rows = [(100 * s + i, "w " * (200 + (i * 131 + s * 77) % 1300), "en", f"s{s}") for s in range(4) for i in range(30)]
    got = mixing.mix(docs(rows)).collect()
    source, taken, target = {r[0]: r[3] for r in rows}, {}, {}
    for r in got:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    with pytest.warns(UserWarning, match="too large"):
        mixing.mix(docs([(1, "w " * 1000, "en", "a"), (2, "w " * 900, "en", "a"), (3, "w " * 800, "en", "b")]))


def test_dual_solution_meets_constraints(spark):
    rng = np.random.default_rng(1)
    sizes = rng.lognormal(4, 1, 500).astype(int) + 1
    hist = spark.createDataFrame([(0, int(s), 1) for s in sizes] + [(1, int(s), 1) for s in sizes], "sid int, size long, n long").groupBy("sid", "size").sum("n").withColumnRenamed("sum(n)", "n")
    total = float(sizes.sum())
    sources = spark.createDataFrame([("a", 0, 500, int(total), 0.4 * total), ("b", 1, 500, int(total), 1.7 * total)], "source string, sid int, n long, source_size long, target double")
    for r in mixing.newton(hist, sources).collect():
        words = (sizes * np.minimum(2, np.exp(np.minimum(r.lam * sizes / (total / 500), 700)))).sum()
        assert words == pytest.approx([0.4, 1.7][r.sid] * total, rel=1e-6)


def brute_rule(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:end].translate({i: i + 32 for i in range(65, 91)})
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


def test_urls(spark):
    found = ["http://A.COM/x?y#z", "https://example.com/en/1", "http://www.example.com/en/", "http://m.www.example.com/en/q", "x://net/es/1", "ftp://a.net/fr/", "http://a.net/de/", "http://com", "http://com/", "notcom/", None, "", "http://xcom/", "a://b://c.com/", "http://\u00c9.com/\u00e9", "http://com?/", "http://q.example.com/en/\n2", "z" * 100_000]
    rows = [(i, u, "own") for i, u in enumerate(found)] + [(0, found[0], "own")] + [(100 + i, f"https://blog{i}.example.{'com' if i % 2 else 'net'}/{'de' if i % 2 else 'fr'}/{i}", "x") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    ratio = urls.train(pages)
    got = urls.judge(pages, ratio).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, fit = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[0]) and r.verdict in ("allow", "block")
        if fit:
            assert r.verdict == fit[1]
    right = [(ratio.advantage([r.url])[0] >= ratio.threshold) == (r.verdict == "allow") for r in got if r.page_id >= 100]
    assert sum(right) / len(right) > 0.95
    none = urls.train(pages.limit(0))
    assert {r.verdict for r in urls.judge(pages, none).where("rule IS NULL").collect()} == {"allow"}


def test_calibration_of_ties():
    assert urls.calibrated(np.array([0.0, 0.0, 1.0, 2.0]), np.array([False, False, True, True])) == 0.5
    assert urls.calibrated(np.array([1.0, 2.0]), np.array([True, True])) == 0.0


def test_urls_learn_from_all(spark, monkeypatch):
    """Every distinct URL that the rules decide is counted, long ones too, and the threshold over all scores is that of the sorted list."""
    pages = spark.range(10000).selectExpr("CASE WHEN id % 2 = 0 THEN concat('http://a.com/', id, if(id = 0, repeat('z', 3000), '')) ELSE concat('http://a.net/fr/', id) END AS url")
    seen, count = [], urls.gram_counts
    monkeypatch.setattr(urls, "gram_counts", lambda rows, *more: (seen.append(rows.count()), count(rows.limit(50), *more))[1])
    urls.train(pages.union(pages))
    assert seen == [pages.where("pmod(xxhash64(url, 'fold'), 4) > 0").count()] and seen[0] > 7000
    r = np.random.default_rng(1)
    scores, good = np.round(r.normal(size=50), 1), r.random(50) < 0.5
    table = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good, strict=True)], "advantage double, good boolean")
    assert urls.calibrated_over(table) == urls.calibrated(scores, good)

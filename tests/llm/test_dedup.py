import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tracewell.llm import exact_dedup, simhash
from tracewell.llm.components import components


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_groups(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i))
    return {k: (min(v)[2], len(v)) for k, v in by.items()}


@pytest.mark.parametrize("counters", [2, 4096])
def test_exact_groups(docs, text, counters):
    rows = [(i, text(i % 7) + " " * (i % 3), "en", None if i % 5 == 0 else "s") for i in range(40)]
    rows += [(50, None, None, None), (51, "", "en", "s"), (52, " \t\n\x0b\x0c\r", "en", "s"), (53, "a\u00a0b", "en", "s"), (54, "ab", "en", "s"), (55, text(99, 30_000), "en", "s"), (None, "null id", "en", "s")]
    want = brute_groups(rows)
    got = {r.doc_id: r for r in exact_dedup.group_rows(docs(rows), counters=counters).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        keep, size = want[squeezed(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, size, keep == i)
        assert got[i].text_sha256 == hashlib.sha256(squeezed(t).encode()).hexdigest()


def test_exact_dedup_keeps_columns_and_repeated_rows(docs):
    rows = [(1, "a b", "en", "s"), (2, "ab", "en", "s"), (3, "c", None, None), (3, "c", None, None), (4, None, "en", "s"), (5, "", "en", "s"), (None, "n", "en", "s"), (None, "n ", "en", "s")]
    table = docs(rows)
    out = exact_dedup.dedup(table)
    assert out.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b"), (3, "c"), (4, None), (None, "n ")], key=str)


def test_empty_tables(docs):
    assert exact_dedup.group_rows(docs([])).count() == 0
    assert exact_dedup.dedup(docs([])).count() == 0
    assert simhash.near_groups(docs([])).count() == 0


def test_misra_gries_finds_every_frequent_digest(spark):
    rows = [(bytes([1]),)] * 400 + [(bytes([2]),)] * 200 + [(bytes([9, i % 250, i // 250]),) for i in range(500)]
    table = spark.createDataFrame(rows, "digest binary").repartition(5)
    found = {bytes(r.digest): r.estimate for r in exact_dedup.misra_gries(table, 8).collect()}
    assert len(found) <= 8 and 0 < found[bytes([1])] <= 400 and found[bytes([2])] <= 200


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_groups_against_brute_force(docs, text):
    rows = []
    for i in range(30):
        base = text(i, 900)
        rows += [(10 * i, base, "en", "s"), (10 * i + 1, base + " tail", "en", "s"), (10 * i + 2, base.replace(" ", "\n", 3), "en", "s")]
    rows += [(900, None, "en", "s"), (901, "", None, None), (902, " \n", "en", "s"), (903, "Uno", "en", "s"), (904, "uno", "en", "s"), (905, "É b", "en", "s"), (906, "é b", "en", "s"), (907, "x " * 70_000, "en", "s")]
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(fps)
    got = {r.doc_id: r for r in simhash.near_groups(docs(rows)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < 40  # links were there to find
    kept = simhash.near_dedup(docs(rows))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == docs(rows).columns


@pytest.mark.parametrize("tile", [8, 2048])
def test_dense_balls_and_tiles(spark, tile):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(40):
            x = centre
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.close_links(spark.createDataFrame(signed, "fingerprint long"), tile=tile)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(links).collect()}
    want = brute_components({x: x for x in fps})
    groups = {}
    for x in fps:
        groups.setdefault(want[x], set()).add(x)
    got = {}
    for x in fps:
        got.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200, 202: 200}


def test_near_dedup_decides_by_row(docs, text):
    """An id with a near copy and an unrelated text loses the copy only."""
    rows = [(1, text(1, 80), "en", "s"), (2, text(1, 80), "en", "s"), (2, text(2, 80), "en", "s"), (3, text(1, 80), "en", "s"), (4, text(3, 80), "en", "s"), (None, text(4, 80), "en", "s")]
    kept = simhash.near_dedup(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(r[0], r[1]) for r in (rows[0], rows[2], rows[4], rows[5])], key=str)

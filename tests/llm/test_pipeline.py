import re

import pytest
from conftest import prose
from test_decontaminate import brute
from test_dedup import brute_components, brute_fingerprint, brute_groups
from test_models import brute_targets

import corpus_pipeline
from tracewell.llm import queries as llm

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    items = [(i, prose(5000 + i, 30)) for i in range(5)]
    rows = []
    for i in range(120):
        t = prose(i, 150 + i)
        rows.append((i, t, ["s0", "s1", "s2", None][i % 4]))
        if i % 10 == 0:
            rows += [(1000 + i, t + "  ", "s0"), (2000 + i, t.replace(" ", "\n"), "s1")]
        if i % 12 == 0:
            rows.append((3000 + i, prose(i, 150 + i) + " more", "s2"))
        if i % 15 == 0:
            rows.append((4000 + i, prose(7000 + i, 50) + " " + items[i % 5][1], "s1"))
    rows += [(9000, None, "s0"), (9001, "12 34 !!", "s1"), (9002, "", None)]
    full = [(i, t, "xx", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), [(i, t, None, s) for i, t, s in rows], items


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs, got = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/stage-{name}")
        docs = spark.read.parquet(f"{path}/stage-{name}")
        got[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "mix":
            assert docs.columns == columns

    left = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert got["language"] == sorted(r[0] for r in left)
    keep = {k for k, _ in brute_groups(left).values()}
    left = [r for r in left if r[0] in keep]
    assert got["exact_dedup"] == sorted(keep)
    parts = brute_components({r[0]: brute_fingerprint(r[1]) for r in left})
    left = [r for r in left if parts[r[0]] == r[0]]
    assert got["near_dedup"] == sorted(r[0] for r in left)
    gone = {r[0] for r in brute([(r[0], r[1]) for r in left], items) if r[5]}
    assert gone
    left = [r for r in left if r[0] not in gone]
    assert got["decontaminate"] == sorted(r[0] for r in left)
    sizes, taken = {}, {}
    size = {r[0]: len(r[1].split()) for r in left}
    source = {r[0]: r[3] for r in left}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    for i in got["mix"]:
        taken[source[i]] = taken.get(source[i], 0) + size[i]
    for s, target in brute_targets(sizes).items():
        assert taken[s] == pytest.approx(target, rel=0.02)
    assert max(got["mix"].count(i) for i in set(got["mix"])) <= 2

    whole = corpus_pipeline.run(spark, path)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == got["mix"]


def test_every_operator_is_registered():
    found = llm.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 11))
    assert set(llm.oracle_sql()) <= set(found)

import hashlib
import re

import pyarrow as pa

from tracewell.llm import fim


def by_definition(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "one line", "\n", "\n\n\n", "a\nb", "a\nb\n", "ends <", "P>\n<\n<S\n>", "holds <P> itself\nx", "<S>", "é\n𝄞𝄞\n日本\n", "\r\nx\r\n", "x" * 200_000 + "\n" + "y\n" * 50_000, "same\ntext\nhere\n", "same\ntext\nhere\n", "\x00\n\x1f", "<\nM>\n",
]


def test_transform_by_definition_and_round_trip(spark, docs, text):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(100 + i, text(i, 5 + i).replace(" ", "\n", i), None, None) for i in range(200)] + [(None, "null\nid", "en", "s"), (3, "again\n3", "en", "s")]
    table = docs(rows).repartition(3)
    for rate, spm_rate in ((100, 50), (40, 0), (100, 100), (0, 50)):
        done = fim.transform(table, rate=rate, spm_rate=spm_rate)
        got = fim.restore(done).collect()
        assert sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == sorted(
            (str(i), n, f, str(p), str(m), out) for i, t, *_ in rows for n, f, p, m, out in [by_definition(i, t, rate, spm_rate)])
        assert sorted(r.restored for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert {r.form for r in fim.transform(table).collect()} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(table.limit(0))).collect() == []


def test_restoring_needs_output_and_form_alone():
    h = [pa.array([x] * 3, pa.int64()) for x in (1, 2, 0, 0)]
    done = fim.cut(pa.array(["a\nb\nc", "<\n<P\n>", "x"]), h)
    assert done["output"].to_pylist() == ["<S>c<P>a\n<M>b\n", "<S>><P><\n<M><P\n", "<S><P><M>x"]
    assert fim.rebuilt(done["output"], done["form"]).to_pylist() == ["a\nb\nc", "<\n<P\n>", "x"]


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(fim.SQL).fetchall()
    got = fim.query(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(want)

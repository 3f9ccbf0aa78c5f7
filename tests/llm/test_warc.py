import base64
import gzip
import hashlib
import random

import pyarrow as pa

from tracewell.llm import warc
from tracewell.llm.common import new_path


def expect(rows):
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        lead = first.get(h or "")
        again = i is not None and i != lead
        out.append((None if i is None else str(i), u, "revisit" if again else "response", str(lead) if again else None, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()))
    return sorted(out, key=str)


def test_round_trip_at_any_split(spark):
    rnd = random.Random(3)
    noise = "".join(chr(rnd.randint(1, 0x2FF)) for _ in range(40_000))
    rows = [(i, f"http://h/{i}", f"<p>{rnd.random()}</p>" * rnd.randint(1, 60)) for i in range(60)]
    rows += [(100, None, None), (101, "http://h/%0A\r\nX: y", ""), (102, "u", rows[3][2]), (2, "http://h/2", rows[2][2]), (103, "u", noise), (104, "u", "\r\n\r\nWARC/1.0\r\n\r\n"), (None, "u", "no id"), (None, "u", rows[0][2]), (-5, "u", rows[1][2])]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, bytes int")
    archives = warc.write_archives(pages, new_path(spark, "test-warc"), archive_bytes=6000)
    assert archives.count() > 4 and archives.agg({"records": "sum"}).first()[0] == len(rows)
    for split in (61, 1777, 1 << 20):
        got = sorted((tuple(r) for r in warc.read_archives(archives, split).collect()), key=str)
        assert got == expect(rows)


def test_ids_with_several_payloads_and_long_urls(spark):
    """Each payload is written, and each row gives one record."""
    rows = [(1, "u", "first"), (2, "u", "second"), (3, "u", "first"), (3, "u", "its own"), (4, "u", "first"), (4, "u", "second"), (5, "http://h/" + "%" * 40_000, "long")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, new_path(spark, "test-warc"))).collect()
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    first = {h: min(i for i, _, x in rows if x == h) for _, _, h in rows}
    want = [(str(i), u, digest(h), "response" if first[h] == i else "revisit", None if first[h] == i else str(first[h])) for i, u, h in rows]
    assert sorted(((r.record_id, r.url, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_least_bytes_and_empty(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "longer text"), (4, "u", "longer text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, new_path(spark, "test-warc"), least=5))
    assert {r.record_id for r in got.where("record_type = 'revisit'").collect()} == {"4"}
    assert warc.read_archives(warc.write_archives(pages.limit(0), new_path(spark, "test-warc"))).count() == 0


def test_false_members_are_passed_over(tmp_path):
    """Magic bytes and whole records inside a stored payload are not records of the file."""
    inner = warc.record(9, "u", b"inner", None, "2024-01-01T00:00:00Z")
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner + b"\x1f\x8b\x08junk"
    outer = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    data = gzip.compress(outer, compresslevel=0) + warc.record(2, "u", b"second", None, "2024-01-01T00:00:00Z")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    whole = []
    for start in range(0, len(data), 37):
        with pa.OSFile(str(path)) as file:
            whole += [h["warc-record-id"] for h, _, _ in warc.records(file, len(data), start, min(len(data), start + 37))]
    assert whole == ["<urn:page:1>", "<urn:page:2>"]


def test_string_ids_and_lost_records(spark):
    ids = [None, "", " ", "p\r\nq", "a%20b", "<urn:page:x>", "é", "x ", "ok"]
    rows = [(i, "u\n%" if k % 2 else " u ", f"html {k // 2}") for k, i in enumerate(ids)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), new_path(spark, "test-warc"))
    got = warc.read_whole(archives).collect()
    assert sorted((str(r.record_id), r.url) for r in got) == sorted((str(i), u) for i, u, _ in rows)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {min(x for x in ids[k : k + 2]) for k in range(2, 8, 2) }
    try:
        warc.read_whole(archives.withColumn("records", archives.records + 1))
        raise AssertionError("a lost record was not noticed")
    except RuntimeError as lost:
        assert "were read" in str(lost)

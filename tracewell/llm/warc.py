"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own, so an archive can be read from any byte: a task looks for gzip's magic bytes in its
range, accepts a candidate when it decodes to a WARC header of the right length and is followed by another member or the
file's end, and owns the records that start inside its range, reading past its end for the last one.

Writing tasks give their files new names and report them; only what successful tasks reported counts, so a task that
runs twice leaves no double records. Archives live in the shared folder and are opened through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, fits, frugal, materialise, new_path, sifted, to_python

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES, SPLIT_BYTES, READ_BYTES = 256 << 20, 8 << 20, 1 << 20
PEEK_BYTES = 512
MOST_TASKS = 50_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
REPORT = "file string, bytes long, records long"
RECORD = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def escaped(value: str) -> str:
    """A header's value on one line, without white space at its ends."""
    value = value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    ends = value.strip()
    return value if ends == value else "".join(f"%{x:02X}" for x in value.encode("utf-8", "replace"))


def unescaped(value: str) -> str:
    return unquote_to_bytes(value).decode("utf-8", "replace")


def urn(ident: object) -> str:
    """What a record is known by; no id and an empty one are told apart."""
    return "<urn:no-page>" if ident is None else f"<urn:page:{escaped(str(ident))}>"


def record(ident: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """One gzip member. A revisit has the HTTP header of the full response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(ident)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{base32_sha1(hashlib.sha1(payload).digest())}")]
    if url is not None:
        head.append(("WARC-Target-URI", escaped(url)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return pack.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + pack.flush()


def payload(html: Column) -> list[Column]:
    """Digest and bytes of a payload; null is empty."""
    text = F.coalesce(html, F.lit(""))
    return [F.unhex(F.sha1(text)).alias("digest"), F.octet_length(text).alias("bytes")]


def revisits(pages: DataFrame, html: str = "html", id_col: str = "page_id", least: int = 0) -> DataFrame:
    """(page_id, digest, bytes, refers_to) of payloads with at least ``least`` bytes that a page with a smaller id has too. Hot payloads are reduced by partial minima and joined from a small table of groups."""
    narrow = materialise(pages.select(F.col(id_col).alias("page_id"), *payload(F.col(html))), "payloads")
    groups = narrow.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = narrow.join(bounded(materialise(groups, "groups")), ["digest", "bytes"]).where("page_id != refers_to")
    return materialise(found.select("page_id", "digest", "bytes", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, url: str = "url", html: str = "html", id_col: str = "page_id", least: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row into archives in folder and returns the written table (file, bytes, records).

    Null html is an empty payload, a null url has no Target-URI. Of equal payloads the smallest page_id is the response; rows that share this id, or have none, are
    responses too.
    """
    first = revisits(pages, html, id_col, least)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"), *payload(F.col(html)))
    key = ["page_id", "digest", "bytes"]  # an id may come with several payloads
    if fits(first):
        rows = rows.join(F.broadcast(first), key, "left")
    else:  # only pages that may be revisits are shuffled
        suspects, clear = sifted(rows, first.select(*key), [F.col(c) for c in key])
        rows = suspects.join(first, key, "left").unionByName(clear.withColumn("refers_to", F.lit(None).cast(first.schema["refers_to"].dataType)))
    rows = rows.select("page_id", "url", "html", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, done = None, []
        try:
            for batch in frugal(batches):
                for ident, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        done.append([f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0])
                        out = store.open_output_stream(f"{root}/{done[-1][0].rpartition('/')[2]}", compression=None)
                    data = record(ident.as_py(), url.as_py(), html.as_py() or b"", refers_to.as_py(), date)
                    out.write(data)
                    done[-1][1] += len(data)
                    done[-1][2] += 1
                    if done[-1][1] >= archive_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "records"])

    return materialise(to_python(rows).mapInArrow(run, REPORT), "archives")


class Window:
    """Bytes of a file from a position on, read piece by piece and forgotten behind it."""

    def __init__(self, file: pa.NativeFile, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, b""

    def upto(self, end: int) -> bytes:
        """The bytes held, after reading on so that they reach end or the file's end."""
        have = self.at + len(self.data)
        if end > have and have < self.size:
            self.file.seek(have)
            self.data += self.file.read(min(max(end - have, READ_BYTES), self.size - have))
        return self.data

    def forget(self, start: int) -> None:
        self.data, self.at = self.data[start - self.at :], start


def member(window: Window, start: int) -> tuple[bytes, int] | None:
    """The decoded member that starts here and its end, if it is a WARC record that another member or the file's end follows."""
    unpack, parts, at, length = zlib.decompressobj(31), [], start, 0
    try:
        while not unpack.eof:
            data = window.upto(at + 1)[at - window.at :]
            if not data:
                return None
            parts.append(unpack.decompress(data))
            at += len(data) - len(unpack.unused_data)
            length += len(parts[-1])
            if length >= 8 and not b"".join(parts[:8])[:7] == b"WARC/1.":
                return None
    except zlib.error:
        return None
    follow = window.upto(at + PEEK_BYTES)[at - window.at :][:PEEK_BYTES]
    whole = b"".join(parts)
    if not whole.startswith(b"WARC/1.") or follow and not begins(follow):
        return None
    return whole, at


def begins(data: bytes) -> bool:
    """Whether a member that decodes to a WARC record begins here."""
    try:
        return data.startswith(MAGIC) and zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def parse(whole: bytes) -> tuple[dict[str, str], bytes, bytes] | None:
    """Header, HTTP header and payload of a record; None if its length isn't what its header says."""
    cut = whole.find(b"\r\n\r\n")
    head = fields(whole[:cut]) if cut > 0 else {}
    if not head.get("content-length", "").isdigit() or len(whole) != cut + 4 + int(head["content-length"]) + 4:
        return None
    http, _, payload = whole[cut + 4 : -4].partition(b"\r\n\r\n")
    return head, http, payload


def records(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The records of a file that start in [start, end)."""
    window, at = Window(file, start, size), start
    while at < end:
        data = window.upto(min(end + len(MAGIC), at + READ_BYTES))
        found = data.find(MAGIC, at - window.at)
        if found < 0:
            at = window.at + max(len(data) - len(MAGIC) + 1, at - window.at + 1)
            if window.at + len(data) >= size:
                return
            window.forget(min(at, window.at + len(data)))
            continue
        at = window.at + found
        if at >= end:
            return
        got = member(window, at)
        if got is None or (parsed := parse(got[0])) is None:
            at += 1
            continue
        yield parsed
        at = got[1]
        window.forget(at)


def ident(urn: str | None) -> str | None:
    return unescaped(urn.removeprefix("<urn:page:").removesuffix(">")) if urn and urn.startswith("<urn:page:") else None


def read_whole(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``read_archives``, written once and held against what the writers have reported (column records): a record that is lost, or read twice, is an error."""
    rows = materialise(read_archives(archives, split_bytes), "records")
    wanted, got = archives.agg(F.sum("records")).first()[0] or 0, rows.count()
    if got != wanted:
        raise RuntimeError(f"{wanted} records were written, {got} were read")
    return rows


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the archives (columns file, bytes): RECORD. Bytes and digest are those of the full payload: computed for responses, as recorded for revisits."""
    splits = archives.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # a number of partitions of its own: by their bytes the few rows would all end up in one task
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    tasks = min(int(tasks), MOST_TASKS)
    numbered = splits.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(tasks)).cast("int"))  # the table of archives is small: neighbours go to different tasks
    splits = numbered.repartitionByRange(tasks, "deal").drop("deal")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = fs.FileSystem.from_uri(name)
                rows = []
                with store.open_input_file(path) as file:
                    for head, http, payload in records(file, size, start, min(size, start + split_bytes)):
                        revisit = head.get("warc-type") == "revisit"
                        length = int(fields(http).get("content-length", "0")) if revisit else len(payload)
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(hashlib.sha1(payload).digest())
                        target = head.get("warc-target-uri")
                        target = target and unescaped(target)
                        rows.append((ident(head.get("warc-record-id")), target, head.get("warc-type"), ident(head.get("warc-refers-to")), length, digest))
                types = [pa.string()] * 4 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in RECORD.split(", ")])

    return to_python(splits).mapInArrow(run, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(pages, new_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    return read_whole(archives).select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

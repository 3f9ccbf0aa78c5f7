"""Fill-in-the-middle: lines of a document become prefix, middle and suffix, and the middle goes last.

All work is pyarrow.compute over whole batches: texts are split into lists of units, flattened with the index of their
document, numbered within it, filtered by role, rebuilt to lists and joined. Marks in between allow the exact text to be
restored from the output and its form alone; texts that hold a mark themselves stay plain.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import frugal, to_python

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Percent of the documents that are cut, percent of those with the suffix first, and what is hashed before the id.
RATE, SPM_RATE, SEED = 100, 50, "7"


def _joined(*pieces: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*pieces, "")


def _rest(a: pa.Array, b: pa.Array) -> pa.Array:
    """a modulo b; neither is negative."""
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Units of all texts (lines with their line feed, and what follows the last one), the row of each, its number in the row from 0, and the number of units of each row."""
    pieces = pc.split_pattern(texts, "\n")
    sizes = pc.list_value_length(pieces)
    flat, row = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    starts = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy())])[:-1], pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(flat)), pa.int64()), starts.take(row))
    last = pc.equal(ordinal, pc.subtract(sizes.cast(pa.int64()).take(row), 1))
    flat = _joined(flat, pc.if_else(last, "", "\n"))
    kept = pc.not_equal(flat, "")  # nothing follows the last line feed
    flat, row, ordinal = flat.filter(kept), row.filter(kept), ordinal.filter(kept)
    return flat, row, ordinal, pa.array(np.bincount(row.to_numpy(), minlength=len(texts)), pa.int64())


def collected(flat: pa.Array, row: pa.Array, n: int) -> pa.Array:
    """Units in order, joined to one text for each of n rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row.to_numpy(), minlength=n))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), "")


def cut(texts: pa.Array, h: list[pa.Array], rate: int = RATE, spm_rate: int = SPM_RATE) -> dict[str, pa.Array]:
    """Columns of a batch: n, form, prefix_chars, middle_chars, output. h holds four hashes of each row."""
    flat, row, ordinal, n = units(texts)
    first, second = _rest(h[0], pc.add(n, 1)), _rest(h[1], pc.add(n, 1))
    low, high = pc.min_element_wise(first, second).take(row), pc.max_element_wise(first, second).take(row)
    before, after = pc.less(ordinal, low), pc.greater_equal(ordinal, high)
    roles = (before, pc.invert(pc.or_(before, after)), pc.and_(pc.invert(before), after))
    prefix, middle, suffix = (collected(flat.filter(r), row.filter(r), len(texts)) for r in roles)
    plain = pc.or_(pc.equal(texts, ""), pc.greater_equal(_rest(h[2], pa.scalar(100, pa.int64())), rate))
    for mark in MARKS:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pc.less(_rest(h[3], pa.scalar(100, pa.int64())), spm_rate)
    moved = pc.if_else(spm, _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    chars = [pc.if_else(plain, None, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return {"n": n, "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), "prefix_chars": chars[0], "middle_chars": chars[1], "output": pc.if_else(plain, texts, moved)}


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that outputs were made of, from these and their forms alone."""
    plain = pc.equal(form, "plain")
    marked = pc.if_else(plain, _joined(*MARKS), output)
    for mark in MARKS[1:]:
        marked = pc.replace_substring(marked, mark, PREFIX)
    pieces = pc.split_pattern(marked, PREFIX)  # what precedes the first mark, and three more
    a, b, middle = (pc.list_element(pieces, i) for i in (1, 2, 3))
    spm = pc.equal(form, "spm")
    return pc.if_else(plain, output, _joined(pc.if_else(spm, b, a), middle, pc.if_else(spm, a, b)))


def transform(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs; other columns are not looked at.

    Draws hash the id, so reruns agree and rows that repeat an id are drawn alike (a null id hashes as an empty one). A null text counts
    as empty; an empty one is plain with no unit, and so is one that holds a mark. A text of one line has all of it in one of the three roles. Nothing is
    shuffled; a batch holds a few MB or one text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *hashes)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            done = cut(batch.column(1), [batch.column(k) for k in range(2, 6)], rate, spm_rate)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(done[k] for k in names)], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return to_python(rows).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """rows, results of ``transform``, with the text rebuilt from output and form in column ``restored``."""
    at = rows.columns.index("output"), rows.columns.index("form")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, rebuilt(*(batch.column(i) for i in at))], [*batch.schema.names, "restored"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return to_python(rows).mapInArrow(run, f"{kinds}, restored string")


def query(spark, sf_dir: str) -> DataFrame:
    done = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: Units are cut at line feeds only, so the text before unit k is that up to its line feed number k; the whole of it if there are fewer.
SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), counted AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM texts
), cuts AS (
    SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi FROM counted
), parts AS (
    SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:], ''), '') AS s,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM cuts
)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

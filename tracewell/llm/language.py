"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ORDER is counted on a bounded sample of labelled documents and then
frozen. A byte costs -log2 of its share in the longest context that has seen it; each longer context, if the language
knows it, first costs its escape (method C: distinct successors against all counts). Below order 0 any byte costs eight
bits. The language with the shortest code for the whole text wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, frugal, materialise, to_python
from tracewell.llm.markov import UNIFORM_BITS, Trees, gram_counts

ORDER = 4
#: The sample that trees are counted on: documents of each language, in expectation (all if there are fewer), of all languages together, and characters of one at most (longer texts are identified, but not learned from).
PER_LANGUAGE, SAMPLE_DOCS, LONGEST = 300, 20_000, 50_000
#: Characters of all of the sample together, in expectation: what the driver holds of their contexts grows no further.
SAMPLE_CHARS = 8_000_000
UNDETERMINED = "und"
GROUP_BYTES = 1 << 18
NO_LETTERS = re.compile(r"[\W\d_]+")


def clean(text: str | None) -> bytes:
    """Lower-cased letters with one space between runs of them, in UTF-8; empty if there is no letter."""
    out = NO_LETTERS.sub(" ", (text or "").lower()).strip(" ")
    return out.encode("utf-8", "replace") if out and (re.search("[a-z]", out) or any(map(str.isalpha, out))) else b""


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Trees | None:
    """Trees from labelled rows with an id and a text that aren't held out: all of a language, or a sample by hash of id and text of ``per_language`` in expectation, fewer where texts are so long that SAMPLE_CHARS would be passed. None if there are no such rows."""
    known = docs.where((F.char_length(text) <= LONGEST) & F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sizes = materialise(known.groupBy(label).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.char_length(text)).alias("__c")), "languages")
    languages = max(1, sizes.count())
    per_language = min(per_language, SAMPLE_DOCS / languages)
    share = F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    rows = known.join(bounded(sizes), label).where((share * F.col("__n") < per_language) & (share * F.col("__c") < SAMPLE_CHARS / languages)).select(F.col(label).alias("label"), F.col(text).alias("text"))
    counts = gram_counts(rows, ORDER, clean).toPandas()  # bounded by the sample
    return Trees(counts, ORDER) if len(counts) else None


def predictions(trees: Trees | None, texts: Iterable[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text. Texts are cleaned one at a time and scored in small groups, so memory stays small whatever the batch."""
    names, scores, rates, group = [], [np.empty(0)], [np.empty(0)], []

    def flush() -> None:
        size = np.array([len(x) for x in group])
        if trees is None or not size.any():
            names.extend([UNDETERMINED] * len(group))
            scores.append(np.zeros(len(group)))
            rates.append(np.zeros(len(group)))
        else:
            bits, n = trees.lengths(group), np.maximum(size, 1)
            least = bits.min(axis=1)
            names.extend(trees.labels[j] if k else UNDETERMINED for j, k in zip(bits.argmin(axis=1), size, strict=True))
            scores.append(np.where(size > 0, 1 / np.exp2(-(bits - least[:, None]) / np.sqrt(n)[:, None]).sum(axis=1), 0))
            rates.append(np.where(size > 0, least / n, 0))
        group.clear()

    held = 0
    for x in texts:
        group.append(clean(x))
        held += len(group[-1])
        if held >= GROUP_BYTES:
            flush()
            held = 0
    if group:
        flush()
    return names, np.concatenate(scores), np.concatenate(rates)


def identify(docs: DataFrame, trees: Trees | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for each row of docs; other columns are not looked at.

    score is the winner's share when each code length is divided by the square root of the text's bytes. A text that is null or has no letter is
    ``und`` with score 0; so is every text if nothing could be learned. Of equal code lengths the first language in order wins.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            names, scores, rates = predictions(model.value, (x.as_py() for x in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rates)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return to_python(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """docs without those rejected: ``und`` (null texts, texts without letters, all if nothing was learned), or texts that the best tree codes no shorter than plain bytes (scripts that no learned language uses). Repeated rows are rows like others, an empty table stays empty; columns stay as they are."""
    at = docs.columns.index(text)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            names, _, rates = predictions(model.value, (x.as_py() for x in batch.column(at)))
            yield batch.filter(pa.array((np.array(names, object) != UNDETERMINED) & (rates < UNIFORM_BITS), pa.bool_()))

    return to_python(docs).mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).withColumn("held_out", held_out())

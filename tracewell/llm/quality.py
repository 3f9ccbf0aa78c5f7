"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each text becomes a short vector: shares of kinds of characters (arcsine of the square root), lengths (logarithms), repetition of
words and lines, entropy. For each class, the mean and covariance come from sums over all labelled rows. A class covariance is
shrunk towards the pooled one, the more the fewer rows the class has, and both towards the identity, which keeps it invertible.
The score is the difference of the two log densities: Mahalanobis distances by the cached inverse Cholesky factors, log determinants and class sizes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, frugal, materialise, to_python
from tracewell.llm.sums import matrix, summed

NAMES = (
    "characters", "words", "upper_share", "digit_share", "mark_share", "symbol_share", "other_alphabet_share", "space_share", "words_per_line", "word_length", "word_length_spread",
    "longest_word", "distinct_words", "commonest_word", "repeats_in_a_row", "distinct_lines", "words_without_letters", "marked_word_ends", "byte_entropy",
)
D = len(NAMES)
#: A class of n rows keeps n / (n + PRIOR) of its own covariance; RIDGE of every covariance is the identity times its mean variance.
PRIOR, RIDGE = 10.0 * D, 0.01
#: Log-density differences are divided by this before they become probabilities: the statistics depend on each other, so that their plain sum is far too sure.
TEMPER = float(D)

_KIND = np.zeros(256, np.int64)  # 0 lower-case and control, 1 upper case, 2 digit, 3 mark, 4 symbol, 5 first byte of a character beyond ASCII, 6 white space, 7 further bytes
for _bytes, _kind in ((range(65, 91), 1), (range(48, 58), 2), (b".,;:!?'\"()-", 3), (b"#$%&*+/<=>@[\\]^_`{|}~", 4), (range(192, 256), 5), (b" \t\n\x0b\x0c\r", 6), (range(128, 192), 7)):
    _KIND[list(_bytes)] = _kind


def _share(part: float, whole: float) -> float:
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str) -> list[float]:
    """The statistics of NAMES, each finite whatever the text; all are 0 for an empty one but those of words and lines, which count as distinct."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    per_byte = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, per_byte, minlength=8)
    chars = float(len(text))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    solid = chars - kinds[6]
    p = per_byte[per_byte > 0] / max(1, raw.size)
    return [
        math.log1p(chars), math.log1p(n), _share(kinds[1], solid), _share(kinds[2], solid), _share(kinds[3], solid), _share(kinds[4], solid), _share(kinds[5], solid), _share(kinds[6], chars),
        math.log1p(n / max(1, len(lines))), math.log1p(sizes.mean()) if n else 0.0, math.log1p(sizes.std()) if n else 0.0, math.log1p(sizes.max()) if n else 0.0,
        math.log1p(len(counts)) / math.log1p(n) if n else 1.0, _share(max(counts.values(), default=0), n), _share(sum(map(str.__eq__, words, words[1:])), n - 1) if n > 1 else 0.0,
        _share(len(set(lines)), len(lines)) if lines else math.pi / 2, _share(sum(not any(map(str.isalpha, w)) for w in counts), len(counts)), _share(sum(not w[-1].isalnum() for w in words), n),
        float(-(p * np.log2(p)).sum()),
    ]


def described(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, x) for each row of docs: its statistics, written once for training and scoring. Null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            x = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return materialise(to_python(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>"), "statistics")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Discriminant(NamedTuple):
    """Scale of the statistics; for each class mean, inverse Cholesky factor of the covariance, and log of its size over the root of its determinant."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        logs = [o - ((z - m) @ f.T * ((z - m) @ f.T)).sum(axis=1) / 2 for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / TEMPER, -700, 700)))


def fit(sums: np.ndarray, prior: float = PRIOR, ridge: float = RIDGE) -> Discriminant | float:
    """From the sums of (1, x)'(1, x) over the rows of each class. Where a class has no row, the share of the other is all that there is to say: 0, 1, or 0.5 without any row."""
    n = sums[:, 0, 0]
    if not n.all():
        return float(n[1] / n.sum()) if n.any() else 0.5
    shift = sums[:, 0, 1:].sum(axis=0) / n.sum()
    means = sums[:, 0, 1:] / n[:, None]
    own = np.stack([s[1:, 1:] / k - np.outer(m, m) for s, k, m in zip(sums, n, means, strict=True)])
    pooled = np.tensordot(n / n.sum(), own, 1)
    scale = np.sqrt(np.maximum(np.diag(pooled), 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    unit = np.outer(scale, scale)
    factors, offsets = [], []
    for k, c in zip(n, own, strict=True):
        mixed = (k * c + prior * pooled) / (k + prior) / unit
        mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / D, 1e-9) * np.eye(D)
        lower = np.linalg.cholesky((mixed + mixed.T) / 2)
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log(k) - np.log(np.diag(lower)).sum())
    return Discriminant(shift, scale, (means - shift) / scale, np.stack(factors), np.array(offsets))


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> Discriminant | float:
    """The discriminant of all rows (doc_id, x) that aren't held out and whose id has the label 0 or 1. Labels with a null id, other values, or of an id labelled both ways are left out; every row of a repeated id counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label).alias("__low"), F.max(label).alias("__high")).where("__low = __high")
    known = materialise(known.select("__id", F.col("__low").cast("int").alias("__label")), "labels")
    seen = rows.join(bounded(known), F.col("doc_id") == F.col("__id")).select("__label", "x")

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        y, x = batch.column(0).to_numpy(), matrix(batch.column(1), D)
        x = np.hstack([np.ones((len(x), 1)), x])
        for k in (0, 1):
            total[k * (D + 1) : (k + 1) * (D + 1)] += x[y == k].T @ x[y == k]

    return fit(summed(seen, (2 * (D + 1), D + 1), add).reshape(2, D + 1, D + 1))


def classify(rows: DataFrame, model: Discriminant | float) -> DataFrame:
    """(doc_id, score, predicted) for each row of (doc_id, x)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            scores = np.full(batch.num_rows, model) if isinstance(model, float) else model.scores(matrix(batch.column(1), D))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = to_python(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, repeated ones too; other columns are not looked at. Texts are read once.

    Null and empty texts are scored by their statistics like any other. Without labels every score is 0.5, with labels of one class 0 or 1; an empty table
    gives an empty result.
    """
    rows = described(docs, text, id_col)
    return classify(rows, train(rows, labels, label, id_col)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

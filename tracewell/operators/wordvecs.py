"""Vectors of words, texts and edges: subword buckets, weighted means, and vectors induced from contexts for words that training has not seen."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.storage import bounded, written
from tracewell.operators.summaries import context_vectors, word_vectors

BUCKETS = 1 << 18
#: Words of a text that are spelled in one row at most; training cuts sequences at 1,000 buckets anyway.
PIECE = 500


def bucket(text: Column, buckets: int = BUCKETS) -> Column:
    """A number below buckets, from the first 32 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def subwords(word: Column, shortest: int = 3, longest: int = 6, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of a word's character n-grams, its edges marked, and of the whole marked word."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    size = F.char_length(marked)
    grams = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    every = F.concat(*(grams(n) for n in range(shortest, longest + 1)), F.array(marked))
    return F.array_distinct(F.transform(every, lambda g: bucket(g, buckets)))


def subword_table(documents: DataFrame, dims: int = 16, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, vec): skip-gram vectors of subword buckets, one table for all words, trained on documents (words) with each word as its buckets. Texts are sequences of buckets, so the reach of a context counts buckets. A long text is spelled in pieces, so no row holds all of its buckets."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(PIECE))
    pieces = documents.select(F.explode(F.transform(starts, lambda i: F.slice("words", i, PIECE))).alias("words"))
    spelled = pieces.select(F.transform(F.flatten(F.transform("words", lambda w: subwords(w, buckets=buckets))), lambda b: b.cast("string")).alias("words"))
    found = word_vectors(written(spelled, "spelled"), dims, seed, window=10).getVectors()
    return written(found.select(F.col("word").cast("long").alias("bucket"), vector_to_array("vector").alias("vec")), "buckets")


def _mean(rows: DataFrame, by: str, weight: Column, dims: int) -> DataFrame:
    """(by, vec) from rows (by, vec, ...) with vectors of at most dims numbers: the weighted mean of vectors, position by position; null where weights sum to 0. One grouping, with a sum for each position."""
    parts = rows.where("size(vec) > 0").select(by, weight.alias("w"), "vec")
    there = lambda j: F.when(F.size("vec") > j, F.col("w"))
    at = lambda j: F.sum(there(j) * F.get("vec", F.lit(j))) / F.nullif(F.sum(there(j)), F.lit(0.0))
    return parts.groupBy(by).agg(F.slice(F.array(*(at(j) for j in range(dims))), F.lit(1), F.max(F.size("vec"))).alias("vec"))


def longest(table: DataFrame) -> int:
    """The most numbers that a vector of a written table has; 1 where there is none."""
    return max(table.agg(F.max(F.size("vec"))).first()[0] or 1, 1)


def subword_vectors(words: DataFrame, table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(word, vec): the mean of a word's known buckets, whether training has seen the word or not. Words without any known bucket are left out."""
    each = words.select("word").distinct().select("word", F.explode(subwords(F.col("word"), buckets=buckets)).alias("bucket"))
    table = written(table, "buckets")
    return _mean(each.join(bounded(table), "bucket"), "word", F.lit(1.0), longest(table))


def text_vectors(documents: DataFrame, vectors: DataFrame, weights: str = "mean", idf: DataFrame | None = None, falls: float = 30.0) -> DataFrame:
    """(node, vec): the mean of the vectors of a document's words; with weights "idf" by idf (word, idf), with "position" by an arithmetic series that falls by ``falls`` percent over the text. Words without a vector count nowhere; nodes with none are left out. documents has one row a node."""
    each = documents.select("node", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    vectors = written(vectors.select("word", "vec"), "vectors")
    met, dims = each.join(bounded(vectors), "word"), longest(vectors)
    if weights == "idf":
        return _mean(met.join(bounded(written(idf.select("word", "idf"), "idf")), "word"), "node", F.col("idf"), dims)
    if weights == "position":
        d = -falls / (100.0 * F.col("n"))
        return _mean(met, "node", 1.0 / F.col("n") - d * (F.col("n") - 1) / 2.0 + F.col("i") * d, dims)
    return _mean(met, "node", F.lit(1.0), dims)


def induction_matrix(documents: DataFrame, vectors: DataFrame, reach: int = 5) -> np.ndarray:
    """The matrix M that takes the mean context of a word to its vector, by least squares without an intercept over all words with a vector. Both sides of the normal equations are sums of outer products, a row of d numbers for each of d rows; the driver solves d equations."""
    context = context_vectors(documents, vectors, reach).select("word", F.transform("vec", lambda x: x / F.col("n")).alias("c"))
    pairs = written(context.join(vectors.select("word", "vec"), "word"), "pairs")
    first = pairs.select(F.size("vec").alias("d")).first()
    if first is None:
        return np.zeros((0, 0))
    d = first.d
    rows = pairs.select(F.posexplode("c").alias("i", "x"), "c", "vec")
    dot = lambda column: F.array(*(F.sum(F.col("x") * F.get(column, F.lit(j))) for j in range(d)))
    sums = {r.i: (r.a, r.b) for r in rows.groupBy("i").agg(dot("c").alias("a"), dot("vec").alias("b")).collect()}
    return np.linalg.lstsq(np.array([sums[i][0] for i in range(d)]), np.array([sums[i][1] for i in range(d)]), rcond=None)[0].T


def induced_vectors(documents: DataFrame, vectors: DataFrame, matrix: np.ndarray, reach: int = 5) -> DataFrame:
    """(word, vec, induced): known words keep their vectors; a word without one has its mean context times the matrix, with length 1. Words without known context are left out."""
    context = context_vectors(documents, vectors, reach)
    unknown = context.join(vectors.select("word"), "word", "left_anti").select("word", F.transform("vec", lambda x: x / F.col("n")).alias("c"))
    row = lambda w: F.aggregate(F.zip_with(F.array(*map(F.lit, map(float, w))), F.col("c"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    raw = unknown.select("word", F.array(*(row(w) for w in matrix)).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    made = raw.withColumn("norm", norm).select("word", F.when(F.col("norm") > 0, F.transform("raw", lambda x: x / F.col("norm"))).otherwise(F.col("raw")).alias("vec"), F.lit(True).alias("induced"))
    return vectors.select("word", "vec", F.lit(False).alias("induced")).dropDuplicates(["word"]).unionByName(made)

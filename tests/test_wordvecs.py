"""Vectors of words and texts against loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import wordvecs as m


def buckets(word, size):
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)}
    return {int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % size for g in grams}


def test_subwords_and_unseen_words(spark):
    words = ["a", "", "usr", "libexec", "été", "x" * 50]
    got = {r.word: set(r.b) for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", m.subwords(F.col("word"), buckets=1000).alias("b")).collect()}
    assert got == {w: buckets(w, 1000) for w in words}
    known = sorted(buckets("usr", 1000))
    table = spark.createDataFrame([(b, [float(i), 1.0]) for i, b in enumerate(known)], "bucket long, vec array<double>")
    vec = {r.word: r.vec for r in m.subword_vectors(spark.createDataFrame([("usr",), ("usr",), ("zzzzz",)], "word string"), table, 1000).collect()}
    assert vec.get("usr") == pytest.approx([np.mean(range(len(known))), 1.0]) and "zzzzz" not in vec


def test_text_vectors(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "?"]), (2, ["?"]), (3, []), (4, ["b"])], "node int, words array<string>")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vec array<double>")
    idf = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "word string, idf double")
    got = {w: {r.node: r.vec for r in m.text_vectors(docs, vec, w, idf).collect()} for w in ("mean", "idf", "position")}
    assert got["mean"][1] == pytest.approx([2 / 3, 2 / 3]) and got["idf"][1] == pytest.approx([2 / 5, 6 / 5]) and got["mean"].keys() == {1, 4}
    d = -30 / 400
    w = [1 / 4 - d * 3 / 2 + i * d for i in range(3)]
    assert got["position"][1] == pytest.approx([(w[0] + w[2]) / sum(w), 2 * w[1] / sum(w)])


def test_induction(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    lists = [[*rng.choice(words, 8)] for _ in range(60)] + [["w0", "new", "w1"], ["w2", "new"], ["alone"]]
    vec = {w: rng.standard_normal(4) for w in words}
    docs = spark.createDataFrame([([str(x) for x in l],) for l in lists], "words array<string>")
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "word string, vec array<double>")

    def mean(word):
        near = [vec[l[j]] for l in lists for i, x in enumerate(l) if x == word for j in range(max(0, i - 2), min(len(l), i + 3)) if j != i and l[j] in vec]
        return np.mean(near, axis=0)

    seen = [w for w in words if any(w in l for l in lists)]
    want = np.linalg.lstsq(np.array([mean(w) for w in seen]), np.array([vec[w] for w in seen]), rcond=None)[0].T
    got = m.induction_matrix(docs, vectors, 2)
    assert np.allclose(got, want)
    made = {r.word: (r.vec, r.induced) for r in m.induced_vectors(docs, vectors, got, 2).collect()}
    new = want @ mean("new")
    assert made["new"][1] and np.allclose(made["new"][0], new / np.linalg.norm(new)) and "alone" not in made and made["w3"] == (vec["w3"].tolist(), False)
    assert m.induction_matrix(docs, vectors.limit(0), 2).shape == (0, 0)


def test_trained_subwords(spark):
    docs = spark.createDataFrame([(i, ["usr", "lib", f"lib{i % 5}"]) for i in range(40)], "node int, words array<string>")
    table = m.subword_table(docs, dims=5, buckets=500)
    assert table.count() == len(set().union(*(buckets(w, 500) for w in ("usr", "lib", *(f"lib{i}" for i in range(5))))))
    unseen = m.subword_vectors(spark.createDataFrame([("library",)], "word string"), table, 500).first()
    assert len(unseen.vec) == 5 and any(unseen.vec)


def test_means_in_one_grouping(spark):
    """No row for each number of a vector, and one grouping; vectors of several lengths count where they have numbers."""
    rows = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [3.0], 3.0), ("a", None, 9.0), ("b", [5.0, None], 0.0)], "k string, vec array<double>, x double")
    got = m._mean(rows, "k", rows.x, 2)
    assert {r.k: r.vec for r in got.collect()} == {"a": [2.5, 2.0], "b": [None, None]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


def test_long_texts_are_spelled_in_pieces(spark, monkeypatch):
    """A text of 5,000 words: no row holds all of its buckets, and none is lost."""
    rows = [(0, [f"w{i % 700}" for i in range(5000)]), (1, ["abc", "abd"]), (2, [])]
    docs = spark.createDataFrame(rows, "node long, words array<string>")
    stored, real = [], m.written
    monkeypatch.setattr(m, "written", lambda df, label: stored.append((label, real(df, label))) or stored[-1][1])
    table = m.subword_table(docs, dims=2, buckets=64)
    spelled = [r.words for r in next(t for label, t in stored if label == "spelled").collect()]
    whole = [r.s for r in docs.select(F.flatten(F.transform("words", lambda w: m.subwords(w, buckets=64))).cast("array<string>").alias("s")).collect()]
    assert max(map(len, spelled)) <= 20 * m.PIECE < len(whole[0])
    assert sorted(b for s in spelled for b in s) == sorted(b for s in whole for b in s)
    assert {str(r.bucket) for r in table.collect()} == {b for s in whole for b in s}

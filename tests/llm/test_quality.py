import math

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import quality


def test_statistics_are_finite_and_tell_what_they_name():
    for t in ("", " ", "\n\n", "a", "1", "é", "日本語", "\x00", "$" * 1000, "w " * 100_000, "\ud800"):
        x = quality.statistics(t)
        assert len(x) == quality.D and all(map(math.isfinite, x))
    named = dict(zip(quality.NAMES, quality.statistics("One TWO two two.\nOne TWO two two.\n12 $$"), strict=True))
    assert named["words"] == math.log1p(10) and abs(math.sin(named["distinct_lines"]) ** 2 - 2 / 3) < 1e-12 and abs(math.sin(named["words_without_letters"]) ** 2 - 2 / 6) < 1e-12
    assert abs(math.sin(named["repeats_in_a_row"]) ** 2 - 0) < 1e-12 and abs(math.sin(named["symbol_share"]) ** 2 - 2 / 30) < 1e-12
    assert dict(zip(quality.NAMES, quality.statistics("x x x y"), strict=True))["repeats_in_a_row"] == math.asin(math.sqrt(2 / 3))


def test_fit_and_scores_by_definition():
    rng = np.random.default_rng(1)
    x = [rng.standard_normal((n, quality.D)) @ rng.standard_normal((quality.D, quality.D)) + k for k, n in enumerate((60, 300))]
    ones = [np.hstack([np.ones((len(a), 1)), a]) for a in x]
    model = quality.fit(np.stack([a.T @ a for a in ones]))
    every, n = np.vstack(x), np.array([60, 300])
    own = [np.cov(a.T, bias=True) for a in x]
    pooled = sum(k * c for k, c in zip(n, own, strict=True)) / n.sum()
    sd, logs = np.sqrt(np.diag(pooled)), []
    for k, a, c in zip(n, x, own, strict=True):
        s = (k * c + quality.PRIOR * pooled) / (k + quality.PRIOR) / np.outer(sd, sd)
        s = (1 - quality.RIDGE) * s + quality.RIDGE * np.trace(s) / quality.D * np.eye(quality.D)
        z = (every - a.mean(axis=0)) / sd
        logs.append(math.log(k) - np.linalg.slogdet(s)[1] / 2 - np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) / 2)
    assert np.allclose(model.scores(every), 1 / (1 + np.exp((logs[0] - logs[1]) / quality.TEMPER)), atol=1e-8)
    none = np.zeros((2, quality.D + 1, quality.D + 1))
    one = none.copy()
    one[1, 0, 0] = 4
    assert quality.fit(none) == 0.5 and quality.fit(one) == 1.0
    flat = none.copy()
    flat[:, 0, 0] = 3  # no statistic varies
    assert np.isfinite(quality.fit(flat).scores(np.ones((2, quality.D)))).all()


def test_held_out_labels_are_never_used(spark, docs, text):
    rows = [(i, text(i, 30) if i % 2 else "$$$ ### " * (i % 7 + 3), "en", "s") for i in range(300)] + [(None, None, None, None), (5, "", None, None), (5, text(5, 30), None, None)]
    table = docs(rows)
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(300)] + [(None, 1, 0), (1, 0, 0), (8, None, 1), (10, 7, 1)], "doc_id long, quality int, row int")
    got = quality.score(table, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    seen = got.where("doc_id IS NOT NULL AND doc_id <> 5").collect()
    held = [r for r in seen if r.held_out]
    assert len(held) > 50 and all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in held)
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score(table, turned).where("doc_id <> 5").collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in seen)
    assert {r.score for r in quality.score(table, labels.limit(0)).collect()} == {0.5}
    assert quality.score(table.limit(0), labels).collect() == []


def test_held_out_accuracy(spark):
    got = quality.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = got.predicted == got.quality
    assert len(got) > 1000 and right.mean() > 0.99 and right[got.quality == 0].mean() > 0.97
    low, high = got.score[got.quality == 0].to_numpy(), got.score[got.quality == 1].to_numpy()
    assert (low[:, None] < high[None, :]).mean() > 0.999

"""Summaries of edges' time series: clusters of streams, drift; words around nodes. The stream clustering sees one edge's series, which ``reduction.sample_long`` bounds first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.running import running
from tracewell.operators.storage import written

class DbStream:
    """Micro-clusters of one series: a point updates all clusters within the radius, or opens one; clusters fade, those that moved together share density."""

    def __init__(self, radius: float, fading: float = 0.0, least: float = 1.0, intersection: float = 0.3):
        self.radius, self.fading, self.least, self.intersection = radius, fading, least, intersection
        self.centers, self.weights, self.times = [], [], []
        self.shared: dict[tuple[int, int], float] = {}

    def learn(self, x: float, now: float) -> None:
        fade = lambda i: 2.0 ** (-self.fading * (now - self.times[i]))
        near = [i for i, c in enumerate(self.centers) if abs(c - x) < self.radius]
        if not near:
            self.centers.append(x)
            self.weights.append(1.0)
            self.times.append(now)
            return
        moved = {}
        for i in near:
            self.weights[i] = self.weights[i] * fade(i) + 1.0
            self.times[i] = now
            moved[i] = self.centers[i] + np.exp(-((x - self.centers[i]) ** 2) * 9 / (2 * self.radius**2)) * (x - self.centers[i])
        for a in near:
            for b in near:
                if a < b:
                    self.shared[a, b] = self.shared.get((a, b), 0.0) + 1.0
        apart = all(abs(moved[a] - moved[b]) >= self.radius for a in near for b in near if a < b)
        if apart or len(near) == 1:
            for i, c in moved.items():
                self.centers[i] = c

    def clusters(self) -> list[tuple[float, float]]:
        """(mean, weight) of the groups of strong micro-clusters that share enough density."""
        strong = [i for i, w in enumerate(self.weights) if w >= self.least]
        up = {i: i for i in strong}

        def find(i: int) -> int:
            while up[i] != i:
                i = up[i]
            return i

        for (a, b), s in self.shared.items():
            if a in up and b in up and s / ((self.weights[a] + self.weights[b]) / 2) > self.intersection:
                up[find(b)] = find(a)
        out: dict[int, list[int]] = {}
        for i in strong:
            out.setdefault(find(i), []).append(i)
        total = lambda g: sum(self.weights[i] for i in g)
        return sorted((sum(self.centers[i] * self.weights[i] for i in g) / total(g), total(g)) for g in out.values())


def stream_clusters(values: DataFrame, column: str, *key: str, fading: float = 0.0) -> DataFrame:
    """(key, mean, weight): clusters of each key's series in time order; the radius is Scott's bandwidth."""
    fields = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")[column].to_numpy(float)
        radius = max(len(x) ** -0.2 * (x.std(ddof=1) if len(x) > 1 else 1.0), 1e-9)
        model = DbStream(radius, fading)
        for i, v in enumerate(x):
            model.learn(v, float(i))
        found = model.clusters()
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, "mean": [m for m, _ in found], "weight": [w for _, w in found]})[[*key, "mean", "weight"]]

    return values.groupBy(*key).applyInPandas(run, f"{fields}, mean double, weight double")


def ks_drift(before: DataFrame, after: DataFrame, column: str, *key: str) -> DataFrame:
    """(key, ks): the two-sample Kolmogorov-Smirnov distance of a key's values before and after, of keys that have both. Running counts go in two levels."""
    both = before.select(*key, F.col(column).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(*key, F.col(column).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.groupBy(*key, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    all_ = steps.groupBy(*key).agg(F.nullif(F.sum("a"), F.lit(0)).alias("all_a"), F.nullif(F.sum("b"), F.lit(0)).alias("all_b"))
    up = running(steps, list(key), ["x"], up_a=F.col("a"), up_b=F.col("b")).join(all_, list(key))
    return up.groupBy(*key).agg(F.max(F.abs(F.col("up_a") / F.col("all_a") - F.col("up_b") / F.col("all_b"))).alias("ks")).where("ks IS NOT NULL")


def martingale(flags: DataFrame, p: float, t: float, *key: str) -> DataFrame:
    """Running exponential martingale m = exp(t * hits - n * ln(1 - p + p * e^t)) of rare hits in each key's order, and its logarithm log_m, which stays finite where m no longer is."""
    rows = running(flags, list(key), ["t", "event_uuid"], __n=F.lit(1), __s=F.coalesce("hit", F.lit(0)))
    log_m = t * F.col("__s") - F.col("__n") * float(np.log(1 - p + p * np.exp(t)))
    return rows.withColumn("log_m", log_m).withColumn("m", F.exp("log_m")).drop("__n", "__s")


def corpus(edges: DataFrame, labels: DataFrame, tokens) -> DataFrame:
    """(node, words): a node's tokens followed by those of its distinct out-neighbours."""
    own = labels.select(F.col("node_id").alias("node"), tokens(F.col("label")).alias("words"))
    near = edges.select("src", "dst").distinct().join(own.select(F.col("node").alias("dst"), "words"), "dst").groupBy("src").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("dst", "words"))), lambda s: s["words"])).alias("more"))
    return own.join(near, own.node == near.src, "left").select("node", F.concat("words", F.coalesce("more", F.array().cast("array<string>"))).alias("words"))


def word_vectors(documents: DataFrame, dims: int = 16, seed: int = 0, window: int = 5, partitions: int | None = None):
    """A fitted word2vec model over column words, trained in as many partitions as shuffles have, or as many as asked for."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=dims, minCount=1, seed=seed, windowSize=window, maxIter=1, numPartitions=partitions or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), inputCol="words", outputCol="vec").fit(documents)


def context_vectors(documents: DataFrame, vectors: DataFrame, reach: int = 5) -> DataFrame:
    """(word, vec, n): the sum of the vectors of the words within ``reach`` of each occurrence of a word, and how many there were."""
    at = written(documents.select(F.monotonically_increasing_id().alias("d"), "words"), "documents").select("d", F.posexplode("words").alias("i", "word"))
    pairs = at.select("d", "word", F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach)).alias("j"), "i").where("i != j")
    met = pairs.join(at.select("d", F.col("i").alias("j"), F.col("word").alias("other")), ["d", "j"]).groupBy("word", "other").agg(F.count(F.lit(1)).alias("n"))
    parts = met.join(vectors.select(F.col("word").alias("other"), "vec"), "other").select("word", "n", F.posexplode("vec").alias("k", "x"))
    sums = parts.groupBy("word", "k").agg(F.sum(F.col("x") * F.col("n")).alias("x"), F.sum("n").alias("n"))
    return sums.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vec"), F.max("n").alias("n"))

"""URL filtering by rules and by a ratio of character language models.

Rules decide first. Other URLs are scored by two smoothed variable-order Markov models, one of accepted and one of
rejected URLs: the difference of their log-likelihoods, divided by the URL's length, against a threshold. The
characters are the bytes of the URL's UTF-8 form, in lower case (URLs are ASCII but for stray letters). The
models are counted on all distinct URLs that the rules decide, but for a part chosen by hash; the threshold is calibrated on
the whole of that part, which the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import lower_ascii, materialise
from tracewell.llm.markov import Trees, gram_counts
from tracewell.operators.running import running
from tracewell.operators.storage import written

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its own.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]
ORDER = 5
#: One distinct URL in so many is kept for calibration.
FOLDS = 4


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. The list is part of the plan and meant to be short."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def letters(url: str | None) -> bytes:
    return (url or "").lower().encode("utf-8", "replace")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with columns host, path, rule and ruled (the rule's verdict)."""
    host, path = host_path(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    return out.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col("__rule.rule")).withColumn("ruled", F.col("__rule.verdict")).drop("__rule")


class Ratio:
    """Models of both verdicts and a threshold for the accepted one's advantage in bits per byte. Without samples of both, all is allowed."""

    def __init__(self, trees: Trees | None = None, threshold: float = 0.0):
        self.trees, self.threshold = trees, threshold

    def advantage(self, urls: list[str | None]) -> np.ndarray:
        data = [letters(x) for x in urls]
        if self.trees is None:
            return np.zeros(len(data))
        bits = self.trees.lengths(data)
        return (bits[:, 1] - bits[:, 0]) / np.maximum([len(x) for x in data], 1)


def calibrated(scores: np.ndarray, accepted: np.ndarray) -> float:
    """The threshold with the highest mean of both verdicts' recall; midway between neighbouring scores, the lowest of equals."""
    order = np.argsort(scores, kind="stable")
    s, good = scores[order], accepted[order]
    if not good.any() or good.all():
        return 0.0
    below_bad, above_good = np.concatenate([[0], np.cumsum(~good)]), good.sum() - np.concatenate([[0], np.cumsum(good)])
    value = below_bad / (~good).sum() + above_good / good.sum()
    cut = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    value[1:-1][s[1:] == s[:-1]] = -1  # a threshold can't part equal scores
    return float(cut[int(value.argmax())])


def calibrated_over(scores: DataFrame) -> float:
    """``calibrated`` of a table (advantage, good) of any length: equal scores are counted, counts run over ranges of scores, and the driver gets the best score and the next one."""
    each = written(scores.groupBy("advantage").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")), "url-scores")
    ends = each.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("advantage").alias("low")).first()
    if not ends.good or not ends.bad:
        return 0.0
    up = running(each, [], ["advantage"], up_good=F.col("good"), up_bad=F.col("bad"))
    value = F.col("up_bad") / float(ends.bad) + (float(ends.good) - F.col("up_good")) / float(ends.good)
    best = up.select(value.alias("value"), (-F.col("advantage")).alias("low")).agg(F.max(F.struct("value", "low")).alias("best")).first().best
    if best.value <= 1.0:  # no better than to accept all
        return ends.low - 1
    return (-best.low + each.where(F.col("advantage") > -best.low).agg(F.min("advantage")).first()[0]) / 2


def train(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> Ratio:
    """Learns from every distinct URL that the rules decide. Folds are drawn by a hash of the URL. The driver gets a row for each distinct gram and verdict, whatever the number of URLs that have it."""
    known = judged(pages.select(url), rules, url).where(F.col("ruled").isNotNull())
    fold = F.pmod(F.xxhash64(F.col(url), F.lit("fold")), F.lit(FOLDS))
    known = materialise(known.select(F.col("ruled").alias("label"), F.col(url).alias("text"), fold.alias("fold")).distinct(), "ruled-urls")
    counts = gram_counts(known.where("fold > 0"), ORDER, letters).toPandas()
    if set(counts["label"]) != {ALLOW, BLOCK}:
        return Ratio()
    ratio = Ratio(Trees(counts, ORDER, blend=True))
    score = advantages(pages.sparkSession.sparkContext.broadcast(ratio))
    ratio.threshold = calibrated_over(known.where("fold = 0").select(score(F.col("text")).alias("advantage"), (F.col("label") == ALLOW).alias("good")))
    return ratio


def advantages(kept):
    """A function of a column of URLs, by a broadcast ratio."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(kept.value.advantage(list(urls)))

    return run


SCORED = T.StructType([T.StructField("advantage", T.DoubleType()), T.StructField("learned", T.StringType())])


def judge(pages: DataFrame, ratio: Ratio, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with columns host, path, rule, advantage and verdict.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the models (an empty text has no advantage, 0). Only
    the URL is looked at; columns of pages with the names above are replaced. Repeated rows get equal verdicts.
    """
    kept = pages.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            ratio = kept.value
            found = ratio.advantage(list(urls))
            yield pd.DataFrame({"advantage": found, "learned": np.where(found >= min(ratio.threshold, 0.0) if ratio.trees is None else found >= ratio.threshold, ALLOW, BLOCK)})

    out = judged(pages, rules, url).withColumn("__score", score(F.col(url)))
    return out.withColumn("advantage", F.col("__score.advantage")).withColumn("verdict", F.coalesce("ruled", F.col("__score.learned"))).drop("__score", "ruled")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(pages)).drop("url")

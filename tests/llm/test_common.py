from pyspark.sql import functions as F

from tracewell.llm import common


def test_discard_beyond_the_bound(spark, docs):
    rows = [(i, f"text {i}", "en", "s") for i in range(300)] + [(None, "no id", None, None), (7, "again", "en", "s")]
    table = docs(rows)
    gone = common.materialise(spark.createDataFrame([(i,) for i in range(0, 300, 7)] + [(None,)], "doc_id long"), "gone")
    want = sorted(i for i, *_ in rows if i is not None and i % 7)
    for bound in (None, 0):
        got = common.discard(table, gone, rows=bound)
        assert sorted(r.doc_id for r in got.collect()) == want and got.columns == table.columns
    none = common.materialise(gone.limit(0), "none")
    assert common.discard(table, none, rows=-1).count() == len(rows)


def test_sieve_clears_most_rows(spark):
    keys = common.materialise(spark.range(0, 20_000, 20).select(F.col("id").alias("k")), "keys")
    suspects, clear = common.sifted(spark.range(20_000).withColumn("text", F.lit("x")), keys, [F.col("id")])
    assert 1000 <= suspects.count() <= 1010 and suspects.count() + clear.count() == 20_000
    assert keys.join(suspects, F.col("k") == F.col("id")).count() == 1000
    assert "text" not in "".join(x for x in clear._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in x)


def test_bounds_of_a_broadcast(spark):
    few = common.materialise(spark.range(10).withColumn("s", F.repeat(F.lit("x"), 10 << 20)), "few")
    assert not common.fits(few) and common.fits(few.select("id")) and not common.fits(few.select("id"), 9)
    nested = common.materialise(spark.range(3).select("id", F.array(F.array(F.lit("a"))).alias("a"), F.struct(F.lit(None).cast("string").alias("b")).alias("c")), "nested")
    assert common.fits(nested)

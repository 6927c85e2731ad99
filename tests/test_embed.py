"""Hashed words are counted in batches, with the numbers that a sum over all words gives."""

from pyspark.sql import functions as F

from attestor.operators.embed import hashed_words


def test_hashed_words_are_signed_counts(spark):
    rows = spark.createDataFrame([(0, "The fee, the FEE and a term."), (1, "Kündigung der Miete 12"), (2, "..."), (3, ""), (4, None)], "k int, t string")
    words = rows.select("k", F.explode(F.split(F.lower("t"), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''").withColumn("s", F.pmod(F.xxhash64("w"), F.lit(16)).cast("int"))
    sums = {(r.k, r.i): r.n for r in words.groupBy("k", F.floor(F.col("s") / 2).alias("i")).agg(F.sum(F.when(F.col("s") % 2 == 0, 1.0).otherwise(-1.0)).alias("n")).collect()}
    found = rows.select("k", hashed_words(F.col("t"), 8).alias("v")).orderBy("k").collect()
    for r in found[:4]:
        v = [sums.get((r.k, i), 0.0) for i in range(8)]
        unit = sum(x * x for x in v) ** 0.5
        assert r.v == ([x / unit for x in v] if unit else v)
    assert found[4].v is None


def test_no_lambda_passes_over_the_vector_for_each_word(spark):
    plan = spark.createDataFrame([("a b",)], "t string").select(hashed_words(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan

"""Canonical texts of any length: their facts without the text in one value."""

from pyspark.sql import functions as F

from attestor.operators import ingest
from attestor.plans import text_queries


def test_facts_equal_those_of_the_whole_text(spark):
    rows = [("a", 2, "second ö"), ("a", 1, "first"), ("a", 3, None), ("b", 1, None), (None, 1, "no key"), (None, 2, ""), ("c", None, "x"), ("c", 1, " "), ("d", 1, "same"), ("d", 1, "again")]
    pages = spark.createDataFrame(rows + [("e", k, f"page {k} " * 50) for k in range(500)], "k string, n int, text string")
    want = ingest.canonical(pages, "k", "n").select("k", F.md5("text").alias("text"), "page_count", "char_count", "token_estimate", F.size("empty_pages").alias("n_empty"))
    got = ingest.canonical_facts(pages, "k", "n")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_text_is_gathered(spark):
    plan = text_queries.canonical_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan

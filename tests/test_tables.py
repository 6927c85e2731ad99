"""Merges and deletes touch the buckets they must, and no others."""

import os

from pyspark.sql import functions as F

from attestor.sources.tables import KeyedTable


def files(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("_bucket=")}


def content(t):
    return sorted((tuple(r) for r in t.read().select("k", "g", "v").collect()), key=str)


def test_merge_and_delete(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ("k", "g"), 16)
    rows = [(k, "a" if k % 2 else None, f"v{k}") for k in range(200)]
    schema = "k long, g string, v string"
    t.create(spark.createDataFrame(rows, schema))
    assert content(t) == sorted(rows, key=str)
    before = files(t.path)
    put = [(3, "a", "new3"), (4, None, "new4"), (4, None, "older4"), (999, "z", "more")]
    touched = t.merge(spark.createDataFrame(put, schema).withColumn("n", F.lit(1)).drop("n"))
    after = files(t.path)
    want = {(k, g): v for k, g, v in rows} | {(3, "a"): "new3", (4, None): "new4", (999, "z"): "more"}
    assert content(t) == sorted(((k, g, v) for (k, g), v in want.items()), key=str)
    changed = {d for d in after if after[d] != before.get(d)}
    assert changed == {f"_bucket={b}" for b in touched} and 0 < len(touched) <= 3 < len(after)
    # Delete by any condition; nulls in it delete nothing.
    before = files(t.path)
    touched = t.delete((F.col("k") < 3) | (F.col("v") == "more"))
    want = {key: v for key, v in want.items() if key[0] >= 3 and v != "more"}
    assert content(t) == sorted(((k, g, v) for (k, g), v in want.items()), key=str)
    assert {d for d in files(t.path) if files(t.path)[d] != before[d]} == {f"_bucket={b}" for b in touched}
    assert t.delete(F.col("g") == "nobody") == [] and t.merge(spark.createDataFrame([], schema)) == []
    t.delete(F.lit(True))
    assert content(t) == [] and t.read().columns == ["k", "g", "v"]
    t.merge(spark.createDataFrame([(1, None, "back")], schema))
    assert content(t) == [(1, None, "back")]


def test_newest_wins_and_one_bucket_is_read(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ("k",), 8)
    t.create(spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("at"), F.lit("old").alias("v")))
    t.merge(spark.createDataFrame([(5, 2, "b"), (5, 3, "a"), (5, None, "z")], "k long, at int, v string"), "at")
    found = t.at(k=5)
    assert [tuple(r) for r in found.collect()] == [(5, 3, "a")]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in scan and "PushedFilters" in scan and "EqualNullSafe(k,5)" in scan

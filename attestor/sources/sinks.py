"""Writes: replaced partitions, appends, text and CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions that rows have and leaves the others, in one job's commit."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Appends; with keys, dealt out by them first, so a partition gets few files."""
    if keys:
        rows.repartition(*keys).write.mode("append").partitionBy(*keys).parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def event_line(*fields: Column) -> Column:
    """One JSON object and a line feed."""
    return F.concat(F.to_json(F.struct(*fields)), F.lit("\n"))


def csv_row(name: Column, page: Column, score: Column, text: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    percent = F.concat(F.format_string("%.0f", score * 100), F.lit("%"))
    return F.concat_ws(",", quoted(name), F.coalesce(page.cast("string"), F.lit("")), percent, quoted(F.substring(text, 1, 500)))


def memo(bookmarks: DataFrame, key: str) -> DataFrame:
    """(key, memo): a numbered list of each key's bookmarks (ord, query, document_name, page, text, note) without blank lines."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", Page "), F.col("page").cast("string"))).otherwise("")
    parts = F.struct("ord", F.array(F.concat(F.lit("Source: "), "document_name", page), F.concat(F.lit("Query: "), "query"), F.col("text"), F.when(F.col("note") != "", F.concat(F.lit("Note: "), "note"))).alias("lines"))
    rows = bookmarks.groupBy(key).agg(F.array_sort(F.collect_list(parts)).alias("b"))
    item = F.transform("b", lambda b, i: F.concat(F.array(F.concat((i + 1).cast("string"), F.lit("."))), F.filter(b["lines"], lambda x: x.isNotNull() & (x != ""))))
    return rows.select(key, F.array_join(F.flatten(item), "\n").alias("memo"))


def export_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("overwrite").text(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)

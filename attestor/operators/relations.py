"""Joins between conversations, documents, comparisons and edits, and changes to tables that have no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those with the same keys."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def latest_per_key(rows: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.col(newest).desc(), F.col(tie).desc())
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the table lacks, the first of repeats by all columns."""
    fresh = rows.join(table.select(*keys), keys, "left_anti")
    by = Window.partitionBy(*keys).orderBy(*[c for c in rows.columns if c not in keys] or keys)
    return fresh.withColumn("_n", F.row_number().over(by)).where("_n = 1").select(*rows.columns)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows whose foreign key is among the keys that go."""
    ids = gone.select(F.col(key).alias("_gone"))
    return {name: rows.join(ids, F.col(fk) == F.col("_gone"), "left_anti") for name, (rows, fk) in tables.items()}


def updated(table: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """table with a column taken from values where they have one."""
    new = values.select(*keys, F.col(column).alias("_new"))
    return table.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*table.columns)


def nested_conversations(conversations: DataFrame, messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each conversation with its messages in order, each with its quotes in order of their names as text (Q10 before Q2)."""
    q = quotes.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("ref", "text", "verified"))).alias("quotes"))
    m = messages.join(q, "message_id", "left")
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "quotes"))).alias("messages"))
    return conversations.join(m, "conv_id", "left")


def of_document(conversations: DataFrame, links: DataFrame, messages: DataFrame, doc_id: int) -> DataFrame:
    """Conversations about a document, with their number of messages."""
    own = conversations.join(links.where(F.col("doc_id") == doc_id), "conv_id", "left_semi")
    return own.join(messages.groupBy("conv_id").agg(F.count("*").alias("messages")), "conv_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def with_names(rows: DataFrame, docs: DataFrame, columns: list[str], default: str = "Unknown document") -> DataFrame:
    """Adds the name of the document in each of the columns."""
    for c in columns:
        names = docs.select(F.col("doc_id").alias("_id"), F.col("name").alias(f"{c}_name"))
        rows = rows.join(names, F.col(c) == F.col("_id"), "left").drop("_id").withColumn(f"{c}_name", F.coalesce(f"{c}_name", F.lit(default)))
    return rows


def all_ready(asked: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """For each key of asked (key, doc_id): whether every document is there and READY."""
    rows = asked.distinct().join(docs.select("doc_id", "status"), "doc_id", "left")
    return rows.groupBy(key).agg(F.count("*").alias("asked"), F.count("status").alias("found"), F.coalesce(F.bool_and(F.coalesce(F.col("status") == "READY", F.lit(False))), F.lit(False)).alias("ready"))


def same_set(members: DataFrame, key: str, member: str, wanted: Column) -> DataFrame:
    """Keys whose set of members is exactly the wanted array."""
    rows = members.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("set"))
    return rows.where(F.col("set") == F.sort_array(F.array_distinct(wanted))).select(key)


def matching_sets(members: DataFrame, key: str, member: str) -> DataFrame:
    """Pairs of keys with equal sets of members. Sets meet by a digest of their sorted members, and are compared whole."""
    rows = members.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("set")).withColumn("h", F.md5(F.array_join(F.col("set").cast("array<string>"), ",")))
    a, b = rows.select(F.col(key).alias("a"), "h", F.col("set").alias("sa")), rows.select(F.col(key).alias("b"), "h", F.col("set").alias("sb"))
    return a.join(b, "h").where((F.col("a") < F.col("b")) & (F.col("sa") == F.col("sb"))).select("a", "b")


def cached_or_missing(asked: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached result, and those without one."""
    return asked.join(cache, keys), asked.join(cache.select(*keys), keys, "left_anti")


def by_type(rows: DataFrame, key: str, kind: str, value: str) -> DataFrame:
    """One map from type to value for each key; of repeats the greatest value."""
    one = rows.groupBy(key, kind).agg(F.max(value).alias(value))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, value)))).alias("by_type"))


def cited(messages: DataFrame, quotes: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, ord, ref, verified) of the references in [Q1] and [Q1, Q2] of messages (key, text), held to the verified quotes."""
    groups = F.regexp_extract_all("text", F.lit(r"\[(Q\d+(?:,\s*Q\d+)*)\]"), F.lit(1))
    refs = F.flatten(F.transform(groups, lambda g: F.split(g, r",\s*")))
    rows = messages.select(key, F.posexplode(refs).alias("ord", "ref"))
    known = quotes.where("verified").select(key, "ref", F.lit(True).alias("_known"))
    return rows.join(known, [key, "ref"], "left").select(key, "ord", "ref", F.coalesce("_known", F.lit(False)).alias("verified"))


def numeric_cites(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, n, citation) of each [n] in messages (key, text, citations); null where there is none of that number."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))
    rows = messages.select(key, "citations", F.explode(F.array_distinct(found)).alias("n"))
    return rows.select(key, "n", F.when(F.col("n") > 0, F.get("citations", F.col("n") - 1)).alias("citation"))


def live_or_fallback(live: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    return live.unionByName(fallback.join(live.select(*keys), keys, "left_anti").select(*live.columns))

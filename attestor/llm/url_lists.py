"""Captures judged by the lists that were in force when they were fetched.

Dated list events (added, removed) become disjoint validity intervals; a capture then joins the entries whose interval
holds its fetch time, on each key under which it can be listed: its host, each parent domain, and its URL without
scheme, query and fragment. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, without user, port and trailing dot; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    return F.when(host != "", host)


def bare(url: Column) -> Column:
    """Host and path of a URL: its key in lists of single pages."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, kind, key, start, end) from events (list, kind, key, at, action).

    action is 'add' or 'remove'. An interval runs from an addition to the next removal, end exclusive; end is null
    where there is none. Repeated additions, and removals of what isn't listed, change nothing. Where both happen at
    one time the removal comes last. Rows with a null in any of the five columns are no events.
    """
    events = entries.select("list", "kind", F.lower("key").alias("key"), F.col("at").cast("timestamp").alias("at"), (F.col("action") == "remove").alias("gone")).dropna().distinct()
    by = Window.partitionBy("list", "kind", "key").orderBy("at", "gone")
    changes = events.withColumn("was", F.coalesce(F.lag("gone").over(by), F.lit(True))).where("gone <> was")
    spans = changes.withColumn("end", F.lead("at").over(by)).where("not gone and (end is null or at < end)")
    return spans.select("list", "kind", "key", F.col("at").alias("start"), "end")


def judge_captures(captures: DataFrame, entries: DataFrame, id_column: str = "page_id", url_column: str = "url", time_column: str = "fetched_at", allow: tuple[str, ...] = ("allow",), salts: int = 16, sendable: int = 1_000_000) -> DataFrame:
    """Returns a row for each capture: page_id, url, fetched_at, host, lists (sorted names of block lists in force), allowed, blocked.

    kind is 'host' (that host), 'domain' (it and all below it) or 'page' (host and path). blocked: some list not in
    `allow` holds the capture and none in `allow` does. A capture with a null or hostless URL, or a null time, is in no
    list. Repeated captures each keep their row. Keys are salted, so a host with a third of all captures meets its few
    intervals in many tasks; the intervals are repeated once for each salt. Where the lists have at most `sendable` different
    keys these are sent to all tasks first, and captures' keys that no list has, such as top-level domains, are not shuffled;
    beyond that bound all keys are. Other columns of either table are ignored.
    """
    rows = captures.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(time_column).cast("timestamp").alias("fetched_at"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    keys = F.concat(parents, F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")), F.struct(F.lit("page").alias("kind"), F.lower(bare(F.col("url"))).alias("key"))))
    asked = rows.where("host is not null and fetched_at is not null").distinct()
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("url", "fetched_at", "page_id"), F.lit(salts)).cast("int"))
    asked = asked.select("page_id", "url", "fetched_at", "salt", F.explode(keys).alias("k")).select("page_id", "url", "fetched_at", "salt", "k.*")
    spans = intervals(entries)
    listed = spans.select("kind", "key").distinct()
    if listed.limit(sendable + 1).count() <= sendable:
        asked = asked.join(F.broadcast(listed), ["kind", "key"], "left_semi")
    spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = asked.join(spans, ["kind", "key", "salt"]).where((F.col("start") <= F.col("fetched_at")) & (F.col("end").isNull() | (F.col("fetched_at") < F.col("end"))))
    held = held.groupBy(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched_at").alias("t")).agg(
        F.sort_array(F.collect_set(F.when(~F.col("list").isin(*allow), F.col("list")))).alias("lists"), F.bool_or(F.col("list").isin(*allow)).alias("allowed")
    )
    out = rows.join(held, F.col("p").eqNullSafe(F.col("page_id")) & F.col("u").eqNullSafe(F.col("url")) & F.col("t").eqNullSafe(F.col("fetched_at")), "left")
    lists, allowed = F.coalesce("lists", F.array().cast("array<string>")), F.coalesce("allowed", F.lit(False))
    return out.select("page_id", "url", "fetched_at", "host", lists.alias("lists"), allowed.alias("allowed"), ((F.size(lists) > 0) & ~allowed).alias("blocked"))

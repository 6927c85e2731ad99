"""Activity, searches and audit: counts, newest rows and pages of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_key


def search_analytics(searches: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent queries (normalised), with their mean number of results; ties by query."""
    rows = searches.groupBy(query_key(F.col("query")).alias("query")).agg(F.count("*").alias("count"), F.bround(F.avg("result_count"), 1).alias("avg_results"))
    return rows.orderBy(F.col("count").desc(), "query").limit(most)


def first_seen_analytics(searches: DataFrame, most: int = 10) -> DataFrame:
    """As search_analytics, ties by what was asked first."""
    rows = searches.groupBy(query_key(F.col("query")).alias("query")).agg(F.count("*").alias("count"), F.min(F.struct("created_at", "event_id")).alias("first"))
    return rows.orderBy(F.col("count").desc(), "first").limit(most).select("query", "count")


def search_totals(searches: DataFrame) -> DataFrame:
    return searches.agg(F.count("*").alias("total"), F.coalesce(F.bround(F.avg("result_count"), 1), F.lit(0.0)).alias("avg_results"))


def since(days: int, now: Column) -> Column:
    """Midnight, so many days before now."""
    return F.date_trunc("day", now) - F.make_dt_interval(F.lit(days))


def action_counts(audit: DataFrame, cutoff: Column) -> DataFrame:
    """Rows by action from a cutoff on; a row of an empty tenant belongs to no tenant's counts."""
    return audit.where(F.col("created_at") >= cutoff).groupBy("action").agg(F.count("*").alias("count"))


def matching(rows: DataFrame, **equal) -> DataFrame:
    """Rows equal to every given value that is not None."""
    given = [F.col(k) == v for k, v in equal.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, given)) if given else rows


def page(rows: DataFrame, newest: str, tie: str, skip: int = 0, most: int = 50) -> DataFrame:
    """Rows in order of time, newest first, from `skip` on; at most 200."""
    return rows.orderBy(F.col(newest).desc(), F.col(tie).desc()).offset(max(0, skip)).limit(min(max(1, most), 200))


def newest_of_each(rows: DataFrame, key: str, newest: str, tie: str, most: int = 50) -> DataFrame:
    """The newest rows of each key: what a bounded ring holds after all rows."""
    by = Window.partitionBy(key).orderBy(F.col(newest).desc(), F.col(tie).desc())
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def retained(rows: DataFrame, now: Column, days: int) -> DataFrame:
    return rows.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def status_and_type(docs: DataFrame) -> DataFrame:
    """Counts by status, by type and in all, from one pass: grouping sets over two columns."""
    rows = docs.groupingSets([["status"], ["file_type"], []], "status", "file_type").agg(F.count("*").alias("count"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "type").otherwise("total")
    return rows.select(kind.alias("kind"), F.coalesce("status", "file_type", F.lit("all")).alias("value"), "count")


def rate_windows(events: DataFrame, minutes: int, limit: int) -> DataFrame:
    """Events of each key in tumbling windows, and whether the limit was passed."""
    rows = events.groupBy(F.window("created_at", f"{minutes} minutes").alias("w"), "key").agg(F.count("*").alias("count"))
    return rows.select(F.col("w.start").alias("window_start"), "key", "count", (F.col("count") > limit).alias("over"))


def coverage(chunks: DataFrame, unreadable: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunks_total, chunks_read, failed, complete) of chunk reads (key, idx, ok) and unreadable pages (key, n)."""
    # The reads of a chunk meet first, so that a document has plain counts: distinct ones would shuffle every read three times. One exchange serves both.
    one = chunks.select(key, "idx", "ok").repartition(key).groupBy(key, "idx").agg(F.max("ok").alias("_ok"), F.min("ok").alias("_all"))
    rows = one.groupBy(key).agg(F.count("idx").alias("chunks_total"), F.count(F.when(F.col("_ok"), F.col("idx"))).alias("chunks_read"), F.array_sort(F.collect_list(F.when(~F.col("_all"), F.col("idx")))).alias("failed"))
    rows = rows.join(unreadable.select(key, F.col("n").alias("_bad")), key, "left")
    whole = (F.col("chunks_read") == F.col("chunks_total")) & (F.size("failed") == 0) & (F.coalesce("_bad", F.lit(0)) == 0)
    return rows.withColumn("complete", whole).withColumn("unreadable_pages", F.coalesce("_bad", F.lit(0))).drop("_bad")


def coverage_text(read: Column, total: Column, complete: Column, unreadable: Column) -> Column:
    sections = F.when(total == 1, "section").otherwise("sections")
    pages = F.when(unreadable > 0, F.concat(F.lit("; "), unreadable.cast("string"), F.when(unreadable == 1, " page").otherwise(" pages"), F.lit(" had no selectable text"))).otherwise("")
    return F.when(complete, F.concat(F.lit("Complete: all "), total.cast("string"), F.lit(" "), sections, F.lit(" read"))).otherwise(F.concat(F.lit("Partial: "), read.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" "), sections, F.lit(" read"), pages))


def not_found(name: Column, read: Column, total: Column, complete: Column, unreadable: Column) -> Column:
    """What is said where no quote was verified."""
    s = lambda c: c.cast("string")
    whole = F.concat(F.lit("I couldn't find it in the document ("), name, F.lit(", "), F.when(total == 1, "1 section").otherwise(F.concat(F.lit("all "), s(total), F.lit(" sections"))), F.lit(" read)."))
    note = F.when(unreadable > 0, F.concat(F.lit(" Note: "), s(unreadable), F.when(unreadable == 1, " page").otherwise(" pages"), F.lit(" had no selectable text and could not be searched."))).otherwise("")
    part = F.concat(F.lit("I couldn't find it in the sections I could read ("), s(read), F.lit(" of "), s(total), F.lit(" sections read from "), name, F.lit("). Absence is not confirmed."), note)
    return F.when(complete, whole).otherwise(part)


def not_found_in_all(coverages: DataFrame, key: str) -> DataFrame:
    """(key, message) over all documents of a question; coverages: key, ord, name, read, total, complete."""
    s = lambda c: F.col(c).cast("string")
    one = F.concat("name", F.lit(" ("), s("total"), F.when(F.col("total") == 1, " section").otherwise(" sections"), F.lit(")"))
    part = F.concat("name", F.lit(": "), s("read"), F.lit("/"), s("total"), F.lit(" sections read"))
    rows = coverages.groupBy(key).agg(F.bool_and("complete").alias("all"), F.array_sort(F.collect_list(F.struct("ord", one.alias("one"), part.alias("part")))).alias("d"))
    whole = F.concat(F.lit("I couldn't find a passage that answers this in any of the documents ("), F.array_join("d.one", ", "), F.lit(" all read)."))
    some = F.concat(F.lit("I couldn't find relevant passages in the sections I could read across the documents ("), F.array_join("d.part", "; "), F.lit("). Absence is not confirmed."))
    return rows.select(key, F.when(F.col("all"), whole).otherwise(some).alias("message"))


def evidence_answer(quotes: DataFrame, key: str, complete: Column | None = None, warning: str = "some sections could not be inspected") -> DataFrame:
    """(key, answer) from verified quotes (key, ord, ref, name, text, page) where nothing else composes one."""
    page_text = F.when(F.col("page") > 0, F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    in_list = F.when(F.col("page") > 0, F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    alone = F.concat(F.lit("According to "), "name", page_text, F.lit(':\n"'), "text", F.lit('" ['), "ref", F.lit("]"))
    item = F.concat(F.lit("• ["), "ref", F.lit("] ("), "name", in_list, F.lit('):\n"'), "text", F.lit('"'))
    rows = quotes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", alone.alias("alone"), item.alias("item")))).alias("q"))
    body = F.when(F.size("q") == 1, F.get("q.alone", F.lit(0))).otherwise(F.concat(F.lit("The following verified passages directly address this question:\n\n"), F.array_join("q.item", "\n\n")))
    notice = "AI composition was temporarily unavailable. Showing the verified evidence collected from the document:\n\n"
    suffix = F.when(F.lit(True) if complete is None else complete, "").otherwise(f"\n\n*Note: Coverage is incomplete — {warning}. Additional terms may exist elsewhere in the document.*")
    return rows.select(key, F.concat(F.lit(notice), body, suffix).alias("answer"))


def healthy(checks: DataFrame, optional: str) -> DataFrame:
    return checks.where(F.col("name") != optional).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("healthy"))


def unfinished(docs: DataFrame, *owner: str) -> DataFrame:
    """Whether any document of an owner (of all, without one) is unfinished, and a line that says which stages they are at."""
    open_ = ~F.col("status").isin("READY", "FAILED")
    listed = F.array_sort(F.collect_list(F.when(open_, F.struct("document_id", "stage"))))
    line = F.array_join(F.transform(listed, lambda d: d["stage"]), "; ")
    return docs.groupBy(*owner).agg(F.coalesce(F.bool_or(open_), F.lit(False)).alias("any"), line.alias("text"))


#: Roles from least to most.
ROLES = ("viewer", "paralegal", "lawyer", "admin")


def role_at_least(role: Column, least: str) -> Column:
    """Whether a role stands at or above another; an unknown role stands below all."""
    known = F.array(*map(F.lit, ROLES))
    return F.array_position(known, F.lower(role)) >= ROLES.index(least) + 1


def containing(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column holds a text, whatever its case."""
    return rows.where(F.contains(F.lower(F.col(column)), F.lit(part.lower())))


def shares_of_greatest(counts: DataFrame, key: str) -> DataFrame:
    """(key, n, share): counts against the greatest of them, as bars of a chart. The greatest is one row, so it goes to all tasks."""
    most = counts.agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(most)).select(key, "n", (F.col("n") / F.col("_most")).alias("share"))


def filled_values(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are neither null nor blank."""
    return rows.where(F.trim(column) != "").select(column).distinct()


def same_any_case(a: Column, b: Column) -> Column:
    """Whether two whole texts are equal but for case; no character of either is a pattern."""
    return F.lower(a) == F.lower(b)


def owned_by_id(rows: DataFrame, ids: DataFrame, key: str, owner: Column) -> DataFrame:
    """Rows whose key is among ids (key) and that belong to the owner asked for."""
    return rows.where(owner).join(ids.select(key), key, "left_semi")

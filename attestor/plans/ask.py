"""From questions to numbered, verified quotes with coverage: one plan over all questions and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import once
from ..operators import activity, chunks, retrieve, verify, views


def sections(docs: DataFrame, questions: DataFrame, most: int = 3, max_tokens: int = 24_000) -> tuple[DataFrame, DataFrame]:
    """(all chunks, those to read for each question). questions: question_id, doc_id, question."""
    parts = chunks.char_chunks(docs, max_tokens)
    asked = questions.select("question_id", "doc_id", retrieve.concepts(F.col("question")).alias("asked"))
    rows = once(parts.join(asked, "doc_id").withColumn("score", retrieve.chunk_score(F.col("text"), F.col("asked"))).drop("asked"))
    picked = retrieve.select_chunks(rows.drop("text"), ["question_id", "doc_id"], most)
    terms = asked.select("question_id", "doc_id", F.col("asked.terms").alias("terms"))
    near = retrieve.widen_selection(picked.select("question_id", "doc_id", "idx", "place").join(terms, ["question_id", "doc_id"]), rows.select("question_id", "doc_id", "idx", "total", "text"), F.col("terms"), ["question_id", "doc_id"], most)
    return parts, once(near).join(rows.select("question_id", "doc_id", "idx", "total", "char_start", "char_end", "text"), ["question_id", "doc_id", "idx"])


def best_sentence(read: DataFrame, questions: DataFrame) -> DataFrame:
    """One candidate quote for each section read: its sentence with the most points. Stands in for a model that extracts quotes."""
    asked = questions.select("question_id", "doc_id", retrieve.concepts(F.col("question")).alias("asked"))
    rows = read.join(asked, ["question_id", "doc_id"]).select("question_id", "doc_id", "idx", "char_start", "char_end", "asked", F.posexplode(T.sentences(F.col("text"))).alias("seq", "text"))
    rows = rows.where(F.length("text").between(20, 2000)).withColumn("points", retrieve.chunk_score(F.col("text"), F.col("asked")))
    first = Window.partitionBy("question_id", "doc_id", "idx").orderBy(F.col("points").desc(), "seq")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1 and points > 0").select("question_id", "doc_id", "idx", "text", F.col("char_start").alias("chunk_start"), F.col("char_end").alias("chunk_end"))


def evidence(candidates: DataFrame, docs: DataFrame, pages: DataFrame, compat: bool = True) -> DataFrame:
    """Candidates (question_id, doc_id, idx, text, chunk_start, chunk_end) as verified and unverified quotes with refs, source ranges and pages."""
    ids = candidates.withColumn("quote_id", F.xxhash64("question_id", "doc_id", "idx", "text"))
    judged = verify.verify_quotes(ids.select("quote_id", "doc_id", "text"), docs, compat=compat)
    keyed = verify.keyed_views(ids, "text", compat)
    # Texts are dealt by document before their views are made, which with their maps are several times as large.
    asked = docs.select("doc_id", "text").repartition("doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    near = views.with_views(asked).drop("text")
    # The first view that holds the first segment gives the range.
    rows = near.withColumnsRenamed({"keep": "vk", "join": "vj", "loose": "vl"}).join(keyed.hint("shuffle_hash"), "doc_id")
    at = lambda view, needle: views.occurrences(F.col(view), F.col(needle))
    rows = rows.select("quote_id", "question_id", "doc_id", "idx", "text", "chunk_start", "chunk_end", at("vk", "keep").alias("ok"), at("vj", "join").alias("oj"), at("vl", "loose").alias("ol"))
    found = F.when(F.size("ok") > 0, F.col("ok")).when(F.size("oj") > 0, F.col("oj")).otherwise(F.col("ol"))
    rows = rows.withColumn("occurrences", found).withColumn("o", verify.primary(F.col("occurrences"), F.col("chunk_start"), F.col("chunk_end")))
    rows = rows.join(judged, "quote_id").select("question_id", "doc_id", "idx", "text", "verified", "kind", "fail_reason", F.size("occurrences").alias("n_occurrences"), F.col("o.start").alias("start"), F.col("o.end").alias("end"))
    rows = verify.numbered(once(rows), ["doc_id", "idx"], ["question_id"])  # read twice: by the verified and the others
    rows = verify.page_of(rows, pages, "start", "page_start")
    last = rows.withColumn("last_char", F.greatest(F.col("start"), F.col("end") - 1))
    return verify.page_of(last, pages, "last_char", "page_end").drop("last_char")


def answers(questions: DataFrame, docs: DataFrame, pages: DataFrame, compat: bool = True, max_tokens: int = 24_000) -> tuple[DataFrame, DataFrame]:
    """(quotes, answers) to questions: an answer is the evidence, or why there is none, with how much was read."""
    parts, read = sections(docs, questions, max_tokens=max_tokens)
    quotes = once(evidence(once(best_sentence(read, questions)), docs, pages, compat))
    total = parts.groupBy("doc_id").agg(F.count("*").alias("chunks_total"))
    seen = read.groupBy("question_id", "doc_id").agg(F.count_distinct("idx").alias("chunks_read"))
    cover = questions.select("question_id", "doc_id").join(total, "doc_id", "left").join(seen, ["question_id", "doc_id"], "left").na.fill(0, ["chunks_total", "chunks_read"])
    cover = cover.withColumn("complete", F.col("chunks_read") == F.col("chunks_total"))
    good = quotes.where("verified").select("question_id", F.expr("cast(substr(ref, 2) as int)").alias("ord"), "ref", F.concat(F.lit("Document "), "doc_id").alias("name"), "text", F.col("page_start").alias("page"))
    said = activity.evidence_answer(good, "question_id")
    name = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    rows = cover.join(said, "question_id", "left")
    return quotes, rows.select("question_id", "doc_id", "chunks_read", "chunks_total", "complete", F.coalesce("answer", activity.not_found(name, F.col("chunks_read"), F.col("chunks_total"), F.col("complete"), F.lit(0))).alias("answer"))

"""Which sections of which documents bear on a question, and nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .vector_index import VectorIndex

ENTITY = rf"page\s+\d+|section\s+[\d.]+|article\s+[\d.]+|{P.W}\d+(?:,\d+)*(?:\.\d+)?(?:\s*(?:days?|months?|years?|percent|%|aed|usd|eur|gbp))?{P.NW}"
SPLIT = r"\s+(?:and|or|with|about|regarding|in relation to|concerning)\s+"


def _known(words: Column) -> Column:
    stop = F.array(*map(F.lit, P.STOP_WORDS))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def concepts(question: Column) -> Column:
    """terms, phrases and entities of a question, each distinct and in order."""
    low = F.lower(question)
    entities = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(low, F.lit(ENTITY), F.lit(0)), lambda m: F.trim(m)), lambda m: F.length(m) > 1))
    plain = F.regexp_replace(low, r'[?.,;:!"()\[\]{}]', " ")
    parts = F.split(plain, SPLIT)

    def grams(words: Column) -> Column:
        pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
        made = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.when(i < F.size(words) - 2, F.array(pair(i), F.concat_ws(" ", pair(i), F.get(words, i + 2)))).otherwise(F.array(pair(i))))
        return F.when(F.size(words) > 1, F.flatten(made)).otherwise(F.array().cast("array<string>"))

    phrases = F.flatten(F.transform(parts, lambda s: grams(_known(F.split(F.trim(s), r"\s+")))))
    hyphens = F.transform(F.regexp_extract_all(question, F.lit(rf"{P.W}[A-Za-z0-9_]+-[A-Za-z0-9_]+{P.NW}"), F.lit(0)), lambda m: F.lower(F.regexp_replace(m, "^([^-]*)-", "$1 ")))
    words = F.transform(F.split(F.regexp_replace(low, r"[^a-z0-9\s-]", " "), r"\s+"), lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    terms = F.flatten(F.transform(_known(words), lambda w: F.when(w.contains("-"), F.concat(F.array(w), _known(F.split(w, "-")))).otherwise(F.array(w))))
    return F.struct(F.array_distinct(terms).alias("terms"), F.array_distinct(F.concat(phrases, hyphens)).alias("phrases"), entities.alias("entities"))


def literal(text: Column) -> Column:
    """A pattern that matches just this text."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\-])", r"\\$1")


def chunk_score(text: Column, asked: Column) -> Column:
    """Points of a section for a question's concepts."""
    # A lambda's argument is evaluated once, an expression that lambdas use as often as they run.
    return F.transform(F.array(F.lower(text)), lambda low: _points(low, asked))[0]


def _often(low: Column, term: Column) -> Column:
    """How often a text holds a term, up to 5. One character after each hit is skipped, as in the count that this follows."""

    def step(at: Column, _: Column) -> Column:
        found = F.call_function("locate", term, low, at["from"])
        return F.when(found > 0, F.struct((at["n"] + 1).alias("n"), (found + F.length(term) + 1).alias("from"))).otherwise(F.struct(at["n"].alias("n"), F.lit((1 << 31) - 1).alias("from")))

    return F.aggregate(F.array(*(F.lit(k) for k in range(5))), F.struct(F.lit(0).alias("n"), F.lit(1).alias("from")), step, lambda at: at["n"])


def _points(low: Column, asked: Column) -> Column:
    total = lambda found: F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    hit = lambda names: F.filter(names, lambda n: F.contains(low, n))
    found = F.array(F.struct(hit(asked["entities"]).alias("entities"), hit(asked["phrases"]).alias("phrases"), hit(asked["terms"]).alias("terms")))

    def counted(hits: Column) -> Column:
        entities, phrases, terms = hits["entities"], hits["phrases"], hits["terms"]
        points = F.size(entities) * 15.0 + F.size(phrases) * 12.0 + total(F.transform(terms, lambda t: 3.0 + 0.5 * _often(low, t)))
        share = (F.size(entities) + F.size(phrases) + F.size(terms)) / F.size(asked["terms"])
        return F.when(F.size(asked["terms"]) > 0, points + F.when(share >= 0.6, 10.0).otherwise(0.0) + F.when(share >= 0.8, 15.0).otherwise(0.0)).otherwise(points)

    return F.transform(found, counted)[0]


def select_chunks(scored: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """Of rows (keys, idx, total, score) the sections to read: the best, then those with at least 3 points and 30% of the best, `most` in all.

    Without any point the first `most` are read; a document's only section is read with score 10. Adds place (1 is best) and selective.
    """
    by = Window.partitionBy(*keys)
    rows = scored.withColumn("score", F.when(F.col("total") == 1, F.lit(10.0)).otherwise(F.col("score")))
    rows = rows.withColumn("best", F.max("score").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.col("score").desc(), "idx")))
    rows = rows.withColumn("first", F.row_number().over(by.orderBy("idx")))
    take = F.when(F.col("best") <= 0, F.col("first") <= most).otherwise((F.col("place") == 1) | ((F.col("place") <= most) & (F.col("score") >= 3) & (F.col("score") >= F.col("best") * 0.3)))
    return rows.where(take).withColumn("selective", (F.col("total") > 1) & (F.col("best") > 0)).drop("first", "best")


def widen_selection(selected: DataFrame, chunks: DataFrame, terms: Column, keys: list[str], most: int = 2) -> DataFrame:
    """Adds the neighbour of a selected section where a term lies within 8% of its edge, up to most + 1 sections in all.

    selected: keys, idx, place. chunks: keys, idx, total, text. Candidates are taken in order of selection, then of terms, start before end.
    """
    rows = selected.withColumn("terms", terms).select(*keys, "idx", "place", "terms").join(chunks.select(*keys, "idx", F.col("total").alias("total"), F.lower("text").alias("low")), [*keys, "idx"])
    edge = F.floor(F.length("low") * 0.08)
    near = F.transform("terms", lambda t, i: F.array(
        F.struct(i.alias("i"), F.lit(0).alias("side"), F.when((F.instr("low", t) > 0) & (F.instr("low", t) - 1 < edge) & (F.col("idx") > 0), F.col("idx") - 1).alias("to")),
        F.struct(i.alias("i"), F.lit(1).alias("side"), F.when((F.instr("low", t) > 0) & (F.length("low") - F.instr(F.reverse("low"), F.reverse(t)) - F.length(t) + 1 > F.length("low") - edge) & (F.col("idx") < F.col("total") - 1), F.col("idx") + 1).alias("to")),
    ))
    found = rows.select(*keys, "place", F.explode(F.flatten(near)).alias("n")).where("n.to is not null")
    found = found.groupBy(*keys, F.col("n.to").alias("idx")).agg(F.min(F.struct("place", "n.i", "n.side")).alias("at"))
    found = found.join(selected.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    held = selected.groupBy(*keys).agg(F.count("*").alias("held"))
    found = found.join(held, keys).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("held") + F.col("k") <= most + 1)
    return selected.select(*keys, "idx").withColumn("expanded", F.lit(False)).unionByName(found.select(*keys, "idx").withColumn("expanded", F.lit(True)))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each query (query_id, query) its k nearest vectors (vec_id, embedding) by cosine, score = (1 + cosine) / 2 to four places: see vector_index."""
    return VectorIndex(vectors).search(queries, k)


def union_of_queries(found: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Hits (query_idx, place, score, text) of several queries as one list: the first of those whose first 100 characters agree, best k by score."""
    first = Window.partitionBy(F.left(F.col(text), F.lit(100))).orderBy("query_idx", "place")
    rows = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.orderBy(F.col("score").desc(), "query_idx", "place").limit(k)


def context_of(citations: DataFrame, key: str) -> DataFrame:
    """Numbered context of each key's citations (place, document_name, page, text)."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", Page "), F.col("page").cast("string"))).otherwise("")
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("document_name"), page, F.lit(":\n"), F.col("text"))
    rows = citations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return rows.select(key, F.array_join("lines.line", "\n\n").alias("context"))

"""Proposed edits held to the one place in a document that they can mean."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import js_trim, strip_commas, value_key

#: What may end a captured value, and the values that an instruction can name.
VALUE, STOP = r"([A-Za-z0-9,.$€£¥\s]+?)", r"(?:(?:\s+(?:in|under|per|for|as)\s+[a-z])|(?<!\d)[.,;]|[;]|$)"
FROM_TO = re.compile(rf"\bfrom\s+{VALUE}\s+to\s+{VALUE}{STOP}", re.I)
REPLACE_WITH = re.compile(rf"\breplace\s+{VALUE}\s+with\s+{VALUE}{STOP}", re.I)
CHANGE_TO = re.compile(rf"\bchange\s+{VALUE}\s+to\s+{VALUE}{STOP}", re.I)
ONLY_TO = re.compile(rf"\b(?:to|make it|set it to)\s+{VALUE}{STOP}", re.I)
VERB = re.compile(r"^(?:change|update|set|modify|increase|decrease|make)\s+(?:the\s+)?", re.I)
NOT_VALUE = re.compile(r"liability|payment|clause|term|cap|section", re.I)
CURRENCY = re.compile(r"\b(AED|USD|EUR|GBP|\$|€|£)\s*([\d,]+(?:\.\d+)?)", re.I)
TIME = re.compile(r"\b(\d+)\s*(days?|business days?|calendar days?|weeks?|months?|years?|hours?)\b", re.I)
NUMBER = re.compile(r"\b[\d,]+(?:\.\d+)?\b")


def occurrence_count(text: Column, target: Column) -> Column:
    """Occurrences that do not overlap."""
    return F.when(F.length(target) > 0, ((F.length(text) - F.length(F.replace(text, target, F.lit("")))) / F.length(target)).cast("int")).otherwise(0)


def contains_value(clause: Column, value: Column) -> Column:
    """A value is in a clause, with or without commas within numbers; as a substring, so 100,000 is in 1,100,000."""
    c, v = value_key(clause), value_key(value)
    return F.when(F.coalesce(clause, F.lit("")).eqNullSafe("") | F.coalesce(value, F.lit("")).eqNullSafe(""), False).otherwise(F.contains(c, v) | F.contains(strip_commas(c), strip_commas(v)))


def actual_value(clause: str | None, expected: str | None) -> str | None:
    """The value that a clause has where another was expected: of the same currency, else of the same unit, else the first number."""
    if not clause:
        return None
    expected = expected or ""
    if m := CURRENCY.search(expected):
        s = m[1]  # as it stands: a $ is an anchor here, as in the rules that this follows
        if found := re.search(rf"(?:{s}\s*[\d,]+(?:\.\d+)?|[\d,]+(?:\.\d+)?\s*{s})", clause, re.I):
            return found[0].strip()
    if m := TIME.search(expected):
        if found := re.search(rf"\b\d+\s*(?:business |calendar )?{m[2]}\b", clause, re.I):
            return found[0].strip()
    if NUMBER.search(expected) and (found := NUMBER.search(clause)):
        return found[0].strip()
    return None


@F.pandas_udf(StringType())
def _actual(clauses: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([actual_value(c, e) for c, e in zip(clauses, expected, strict=True)], dtype=object)


def actual_value_in(clause: Column, expected: Column) -> Column:
    return _actual(value_key(clause), expected)


def _clean(value: str) -> str:
    value = re.sub("^[\"'“”‘’]+|[\"'“”‘’]+$", "", value)
    return re.sub(r"[.,;]+$", "", value).strip()


def intents_of(instruction: str | None) -> list[dict]:
    """What a normalised instruction asks for: expected original (or none), replacement and concept of each of its parts."""
    out = []
    for part in filter(None, (s.strip() for s in re.split(r"\s+and\s+|;|\.\s+", instruction or "", flags=re.I))):
        concept = lambda m: VERB.sub("", part[: m.start()].strip()).strip() or None  # noqa: E731, B023
        for pattern in (FROM_TO, REPLACE_WITH, CHANGE_TO):
            m = pattern.search(part)
            old, new = (_clean(m[1]), _clean(m[2])) if m else ("", "")
            if old and new and (pattern is not CHANGE_TO or re.search(r"[\d$€£¥]", old) and not NOT_VALUE.search(old)):
                out.append({"expected": old, "replacement": new, "concept": concept(m) if pattern is FROM_TO else None, "part": part})
                break
        else:
            m = ONLY_TO.search(part)
            if m and _clean(m[1]):
                out.append({"expected": None, "replacement": _clean(m[1]), "concept": concept(m), "part": part})
    return out


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("expected", "replacement", "concept", "part")])))
def _intents(texts: pd.Series) -> pd.Series:
    return texts.map(intents_of)


def intents(instructions: DataFrame, key: str = "instruction_id") -> DataFrame:
    """(key, ord, expected, replacement, concept, part) of instructions (key, instruction)."""
    return instructions.select(key, F.posexplode(_intents(value_key(F.col("instruction")))).alias("ord", "i")).select(key, "ord", "i.*")


def anchors(edit: dict[str, Column]) -> Column:
    """(anchor, offset of the target in it) of an edit: before and after, before, after, in this order."""
    target, before, after = edit["target"], F.coalesce(edit["context_before"], F.lit("")), F.coalesce(edit["context_after"], F.lit(""))
    b, a = js_trim(before), js_trim(after)
    gap_b, gap_a = F.when(before.endswith(" "), " ").otherwise(""), F.when(after.startswith(" "), " ").otherwise("")
    lead = F.concat(b, gap_b)
    made = lambda anchor, at: F.struct(anchor.alias("anchor"), at.cast("int").alias("at"))
    full = F.concat(lead, target, gap_a, a)
    return F.filter(F.array(
        F.when((b != "") & (a != ""), made(full, F.instr(full, target) - 1)),
        F.when(b != "", made(F.concat(lead, target), F.length(lead))),
        F.when(a != "", made(F.concat(target, gap_a, a), F.lit(0))),
    ), lambda x: x.isNotNull())


def verify_edits(edits: DataFrame, docs: DataFrame) -> DataFrame:
    """Verifies edits (schemas.EDIT) against the documents (doc_id, text) that they name.

    Adds verified, occurrences, match_start (of the one place meant), matched_clause and drop_reason. A target that
    occurs more than once is resolved by its passage, then by its context; never by a guess.
    """
    rows = edits.join(docs.select("doc_id", F.col("text").alias("doc")), "doc_id", "left").withColumn("doc", F.coalesce("doc", F.lit("")))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("target", "replacement")})
    wanted = F.coalesce(F.col("expected_original"), F.lit("")) != ""
    off_target = wanted & ~contains_value(F.col("target"), F.col("expected_original"))
    off_passage = wanted & (F.coalesce("passage", F.lit("")) != "") & ~contains_value(F.col("passage"), F.col("expected_original"))
    failed = F.coalesce(F.col("pre_failed"), F.lit(False)) | off_target | off_passage
    actual = F.coalesce(F.nullif("actual_document_value", F.lit("")), actual_value_in(F.col("passage"), F.col("expected_original")), F.when(off_target & (F.col("target") != ""), F.col("target")), F.lit("a different value"))
    place = lambda needle: occurrence_count(F.col("doc"), needle)
    rows = rows.withColumns({"failed": failed, "actual": actual, "n": place(F.col("target"))})
    has_passage = (F.coalesce("passage", F.lit("")) != "") & F.contains(F.col("passage"), F.col("target"))
    rows = rows.withColumn("np", F.when(has_passage, place(F.col("passage"))).otherwise(0))
    tried = F.transform(anchors({c: F.col(c) for c in ("target", "context_before", "context_after")}), lambda x: F.struct(x["anchor"].alias("anchor"), x["at"].alias("at"), place(x["anchor"]).alias("n")))
    rows = rows.withColumn("tried", tried).withColumn("hit", F.get(F.filter("tried", lambda x: x["n"] == 1), F.lit(0))).withColumn("most", F.coalesce(F.array_max(F.transform("tried", lambda x: x["n"])), F.lit(0)))
    found = lambda needle: F.instr(F.col("doc"), needle) - 1
    start = F.when(F.col("n") == 1, found(F.col("target"))).when(F.col("np") == 1, found(F.col("passage")) + F.instr("passage", F.col("target")) - 1).when((F.col("np") <= 1) & F.col("hit").isNotNull(), found(F.col("hit.anchor")) + F.col("hit.at"))
    times = F.concat(F.lit("Target text is ambiguous (appears "), F.col("n").cast("string"), F.lit(" times in "))
    ask = "Please specify more surrounding context to isolate the exact clause."
    reason = (
        F.when(F.col("failed"), F.coalesce(F.nullif("pre_failed_reason", F.lit("")), F.concat(F.lit("The specified original value "), F.coalesce("expected_original", F.lit("undefined")), F.lit(" was not found in the identified clause. The document contains "), F.col("actual"), F.lit(" instead. No change was applied."))))
        .when(js_trim(F.col("target")) == "", "Target text is empty.")
        .when(F.col("target") == F.col("replacement"), "Target and replacement are identical; no revision required.")
        .when(F.col("n") == 0, "Target text was not found in the document. Edits cannot be safely applied.")
        .when((F.col("n") == 1) | (F.col("np") == 1), None)
        .when(F.col("np") > 1, F.concat(times, F.lit("document, and surrounding clause appears "), F.col("np").cast("string"), F.lit(f" times). {ask}")))
        .when(F.col("hit").isNotNull(), None)
        .when(F.col("most") > 1, F.concat(times, F.lit("document, and surrounding context matches "), F.col("most").cast("string"), F.lit(f" locations). {ask}")))
        .otherwise(F.concat(times, F.lit(f"the document). {ask}")))
    )
    rows = rows.withColumn("drop_reason", reason).withColumn("verified", F.col("drop_reason").isNull())
    seen = F.when(F.col("verified"), 1).when(F.col("failed") | (js_trim(F.col("target")) == ""), 0).when((F.col("n") < 2) | (F.col("target") == F.col("replacement")), F.col("n")).when(F.col("np") > 1, F.col("np")).when(F.col("most") > 1, F.col("most")).otherwise(F.col("n"))
    clause = F.when(F.col("verified") & (F.col("n") > 1), F.when(F.col("np") == 1, F.col("passage")).otherwise(F.col("hit.anchor")))
    return rows.select(*edits.columns, "verified", seen.alias("occurrences"), F.when(F.col("verified"), start).alias("match_start"), clause.alias("matched_clause"), "drop_reason")


def passages_in(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct passages (doc_id, ord, passage) that their document holds, as they stand or with white space collapsed; the first of repeats."""
    key = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = passages.join(docs.select("doc_id", "text"), "doc_id").where((F.trim("passage") != "") & (F.contains(F.col("text"), F.col("passage")) | F.contains(key(F.col("text")), key(F.col("passage")))))
    return rows.groupBy("doc_id", "passage").agg(F.min("ord").alias("ord"))


def correlated(edits: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds to edits (instruction_id, edit_id, target, replacement) the intent that each serves: one with its replacement, else one whose concept it holds, else the only one."""
    pairs = edits.join(asked.select("instruction_id", "ord", F.col("replacement").alias("asked"), "concept", "expected"), "instruction_id", "left")
    alone = F.count("ord").over(Window.partitionBy("instruction_id", "edit_id")) == 1
    low = lambda c: F.lower(F.col(c))
    rank = F.when(F.contains(low("replacement"), low("asked")) | F.contains(low("asked"), low("replacement")), 0).when(F.contains(low("target"), low("concept")), 1).when(alone, 2)
    pairs = pairs.withColumn("rank", rank)
    first = Window.partitionBy("instruction_id", "edit_id").orderBy(F.col("rank").asc_nulls_last(), "ord")
    rows = pairs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return rows.withColumns({c: F.when(F.col("rank").isNotNull(), F.col(c)) for c in ("asked", "concept", "expected")}).drop("rank", "ord")


def chosen(edits: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Verified edits that are in ids or, without ids, included."""
    pick = F.col("edit_id").isin(ids) if ids is not None else F.col("include")
    return edits.where(F.col("verified") & pick)


def applied(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts with one verified edit each document put in place (doc_id, match_start, target, replacement)."""
    rows = docs.join(edits.select("doc_id", "match_start", "target", "replacement"), "doc_id")
    return rows.select("doc_id", F.overlay("text", "replacement", F.col("match_start") + 1, F.length("target")).alias("text"))


def untouched_paragraphs(old: Column, new: Column, changed: Column) -> Column:
    """Paragraphs at the same place are equal, but for the places in `changed`; and there are as many."""
    pairs = F.arrays_zip(old.alias("o"), new.alias("n"), F.sequence(F.lit(0), F.size(old) - 1).alias("i"))
    return (F.size(old) == F.size(new)) & F.forall(pairs, lambda p: F.array_contains(changed, p["i"]) | (p["o"] == p["n"]))


def edit_counts(edits: DataFrame, key: str) -> DataFrame:
    return edits.groupBy(key).agg(F.count("*").alias("proposed"), F.count_if(~F.col("verified")).alias("dropped"))


def day_label(at: Column, today: Column) -> Column:
    ago = F.datediff(today, F.to_date(at))
    return F.when(ago == 0, "Today").when(ago == 1, "Yesterday").otherwise(F.date_format(at, "yyyy-MM-dd"))

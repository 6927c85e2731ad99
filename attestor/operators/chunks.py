"""Sections of documents: windows of words, and windows of characters that end at paragraphs, lines, sentences or words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

SENTENCE_END = re.compile(r"[.!?]\s+(?=[^.!?]*$)")


def word_chunks(pages: DataFrame, size: int = P.WORDS, overlap: int = P.WORD_OVERLAP, key: str = "doc_id") -> DataFrame:
    """Windows of `size` words of each page (key, page_no, text), `overlap` words shared; chunk_index runs across a document's pages.

    A page without words has no chunk. Needs overlap < size.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    words = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != "")
    rows = pages.select(key, "page_no", words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - overlap - 1), F.lit(step))
    # Windows are cut where the words are, so that no row but one holds all words of a page.
    part = lambda at: F.slice("words", at + 1, F.lit(size))
    made = F.transform(starts, lambda at: F.struct(at.alias("start"), F.least(F.size("words") - at, F.lit(size)).alias("n_words"), F.array_join(part(at), " ").alias("text")))
    rows = rows.select(key, F.col("page_no").alias("page"), F.explode(made).alias("c")).select(key, "page", "c.*")
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("page", "start")) - 1
    return rows.select(key, ordinal.alias("chunk_index"), "page", F.floor(F.col("start") / size + 1).cast("int").alias("paragraph"), "n_words", "text")


def cut_text(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text."""
    if len(text) <= most:
        return [(0, len(text))] if text else []
    out, start = [], 0
    while True:
        if len(text) - start <= most:
            return [*out, (start, len(text))]
        low, hard = start + most * 6 // 10, start + most
        end = -1
        for mark in ("\n\n", "\n"):
            at = text.rfind(mark, low, hard)
            if at >= 0:
                end = at + len(mark)
                break
        if end < 0:
            m = SENTENCE_END.search(text[low:hard])
            if m:
                end = low + m.start() + 1
        if end < 0:
            at = text.rfind(" ", low, hard)
            end = at + 1 if at >= 0 else -1
        end = hard if end <= start else end
        out.append((start, end))
        after = max(start + 1, end - overlap)
        for mark in ("\n\n", "\n"):
            at = text.find(mark, after, end)
            if at >= 0 and at + len(mark) < end:
                after = at + len(mark)
                break
        start = after


def char_chunks(docs: DataFrame, max_tokens: int = P.CHUNK_TOKENS, overlap_tokens: int | None = None, key: str = "doc_id") -> DataFrame:
    """Chunks (key, idx, total, char_start, char_end, text) of texts of at most 4 * max_tokens characters; a text's cuts depend on each other, texts do not."""
    most = max_tokens * 4
    overlap = overlap_tokens * 4 if overlap_tokens is not None else min(max(round(most * 0.05), 200), 4000)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": s, "end": e} for s, e in cut_text(t or "", most, overlap)])

    rows = docs.select(key, "text", cuts("text").alias("cuts"))
    rows = rows.select(key, "text", F.size("cuts").alias("total"), F.posexplode("cuts").alias("idx", "cut"))
    return rows.select(key, "idx", "total", F.col("cut.start").alias("char_start"), F.col("cut.end").alias("char_end"), F.substring("text", F.col("cut.start") + 1, F.col("cut.end") - F.col("cut.start")).alias("text"))

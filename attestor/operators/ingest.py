"""From pages of positioned items to canonical text with page offsets, and checks on what was uploaded."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import patterns as P
from ..functions import text as T
from ..lineage import once

#: What a file must begin with, and what it must not.
PDF, ZIP, EXECUTABLE = "25504446", "504B0304", ("4D5A", "7F454C46", "CAFEBABE", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "2321")
EXTENSIONS = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain"}


def upload_error(name: Column, content: Column, limit: int = P.UPLOAD_BYTES) -> Column:
    """Why an upload is refused, or null: the first of empty, too large, executable, type, and what its type must hold."""
    size, head = F.octet_length(content), F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    tail = F.decode(F.substring(content, F.greatest(F.lit(1), size - 1023), F.lit(1024)), "ISO-8859-1")
    program = F.lit(False)
    for magic in EXECUTABLE:
        program = program | head.startswith(magic)
    return (
        F.when(size == 0, "EMPTY_FILE").when(size > limit, "FILE_TOO_LARGE").when(program, "EXECUTABLE").when(~ext.isin("pdf", "docx"), "UNSUPPORTED_TYPE")
        .when(ext == "pdf", F.when(~head.startswith(PDF + "2D"), "INVALID_PDF").when(size < 64, "CORRUPT_PDF").when(~F.contains(tail, F.lit("%%EOF")), "CORRUPT_PDF"))
        .when(~head.startswith(ZIP), "INVALID_DOCX")
        .when(~F.contains(F.hex(content), F.hex(F.lit("word/document.xml"))), "INVALID_DOCX")
    )


def upload_error_py(name: Column, mime: Column, size: Column, limit: int = P.UPLOAD_BYTES_PY) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    expected = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext)
    return F.when(expected.isNull(), "UNSUPPORTED_TYPE").when(size > limit, "FILE_TOO_LARGE").when(mime.isNotNull() & (mime != "application/octet-stream") & (mime != expected), "MIME_MISMATCH")


def visible(text: Column) -> Column:
    """Number of characters other than white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), P.SPACE_RUN, ""))


def scan_check(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chars, scanned) of pages (key, page_no, text): under 50 visible characters, or three pages or more with under 5 each."""
    rows = pages.select(key, visible(F.col("text")).alias("n")).groupBy(key).agg(F.sum("n").alias("chars"), F.count("*").alias("pages"), F.count_if(F.col("n") < 5).alias("bare"))
    return rows.select(key, "chars", ((F.col("chars") < 50) | ((F.col("pages") >= 3) & (F.col("bare") == F.col("pages")))).alias("scanned"))


def repeated_furniture(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, mask, pages) of masked lines in the outer bands of at least max(2, 40%) of a document's pages. items: key, page_no, str, y, height."""
    total = items.groupBy(key).agg(F.count_distinct("page_no").alias("all"))
    banded = items.where(in_band() & (T.js_trim(F.col("str")) != "")).select(key, T.digit_mask(F.col("str")).alias("mask"), "page_no")
    found = banded.groupBy(key, "mask").agg(F.count_distinct("page_no").alias("pages"))
    return found.join(total, key).where((F.col("all") > 1) & (F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("all") * 0.4)))).select(key, "mask", "pages")


def in_band() -> Column:
    return (F.col("y") <= F.col("height") * 0.12) | (F.col("y") >= F.col("height") * 0.88)


def strip_furniture(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """items without repeated lines of the outer bands, bare page numbers and blanks. A document of one page keeps its blanks."""
    total = items.groupBy(key).agg(F.count_distinct("page_no").alias("_all"))
    marks = repeated_furniture(items, key).select(key, F.col("mask").alias("_mask"), F.lit(True).alias("_furniture"))
    rows = items.join(total, key).withColumn("_mask", T.digit_mask(F.col("str"))).join(marks, [key, "_mask"], "left")
    blank = T.js_trim(F.col("str")) == ""
    gone = T.bare_page_number(F.col("str")) | ((F.col("_all") > 1) & (blank | (in_band() & F.coalesce("_furniture", F.lit(False)))))
    return rows.where(~gone).select(*items.columns)


def assemble_page(items: list[dict], height: float) -> tuple[str, list[tuple]]:
    """Text and (start, len, x, y, w, h) of a page's items; a newline where the line changes, a space over a visible gap."""
    text, out, before = "", [], None
    tenth = lambda v: int(v * 10 + 0.5) / 10 if v >= 0 else -int(-v * 10 + 0.5) / 10
    for it in items:
        if not it["str"]:
            continue
        t = [*(it["transform"] if it["transform"] is not None else ()), *[0.0] * 6][:6]
        tall = it["height"] or abs(t[3] or 1) or 10
        wide = it["width"] or len(it["str"]) * 6 * abs(t[0] or 1)
        if before is not None:
            if before["has_eol"] or abs(t[5] - before["y"]) > 3:
                text += "" if text.endswith("\n") else "\n"
            elif t[4] - before["right"] > 1.5 and not text.endswith((" ", "\n")) and not it["str"].startswith(" "):
                text += " "
        out.append((len(text), len(it["str"]), max(0.0, tenth(t[4])), max(0.0, tenth(height - t[5] - tall)), tenth(wide), tenth(tall)))
        text += it["str"]
        before = {"has_eol": it["has_eol"], "y": t[5], "right": t[4] + wide}
    return text, out


PLACED = ("start", "len", "x", "y", "w", "h")
KEPT = ["doc_id", "page_no", "width", "height", "text", "items", "path", "name", "kind", "whole", "error"]


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, width, height, text, items) of raw pages (schemas.RAW_PAGE)."""

    def run(batches):
        for rows in batches:
            made = [assemble_page(list(i) if i is not None else [], h or 0.0) for i, h in zip(rows["items"], rows["height"], strict=True)]
            yield pd.DataFrame({"doc_id": rows.doc_id, "page_no": rows.page_no, "width": rows.width, "height": rows.height, "text": [m[0] for m in made], "items": [[dict(zip(PLACED, i, strict=True)) for i in m[1]] for m in made]})

    return pages.mapInPandas(run, f"doc_id long, page_no int, width double, height double, text string, items array<{schemas.PAGE_ITEM}>")


def page_offsets(pages: DataFrame, key: str = "doc_id", order: str = "page_no") -> DataFrame:
    """Adds char_start and char_end in the canonical text, where pages are joined by a blank line that belongs to none."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text").cast("long") + 2).over(before), F.lit(0).cast("long"))
    return pages.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))


def canonical(pages: DataFrame, key: str = "doc_id", order: str = "page_no") -> DataFrame:
    """(key, text, page_count, char_count, token_estimate, empty_pages) of pages (key, order, text)."""
    rows = pages.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("page_count"),
        F.array_sort(F.collect_list(F.when(visible(F.col("text")) < 5, F.col(order)))).alias("empty_pages"))
    return rows.select(key, "text", "page_count", F.length("text").cast("long").alias("char_count"), T.tokens(F.length("text")).alias("token_estimate"), "empty_pages")


def canonical_facts(pages: DataFrame, key: str = "doc_id", order: str = "page_no") -> DataFrame:
    """(key, text, page_count, char_count, token_estimate, n_empty) as of canonical, with the MD5 digest for the text, which is never put together.

    The pages of a key are read in order, one after the other, and only the digest's state is held, so a key's text may be
    of any length. A digest is serial: each key's pages pass through one task.
    """

    def run(batches):
        now, digest = None, None
        for batch in batches:
            kind = batch.column(0).type
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or k != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.md5()
                else:
                    digest.update(b"\n\n")
                digest.update(t)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([x for _, x in done], pa.string())], ["_key", "text"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()], pa.string())], ["_key", "text"])

    own = pages.select(F.col(key).alias("_key"), F.col(order).alias("_order"), "text").where("text is not null").repartition("_key").sortWithinPartitions("_key", "_order", "text")
    digests = own.select("_key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"_key {pages.schema[key].dataType.simpleString()}, text string")
    length = F.length("text").cast("long")
    facts = pages.groupBy(key).agg(
        F.count("*").alias("page_count"), F.coalesce(F.sum(length) + 2 * (F.count("text") - 1), F.lit(0).cast("long")).alias("char_count"),
        F.count(F.when(visible(F.col("text")) < 5, F.col(order))).cast("int").alias("n_empty"))
    rows = facts.join(digests, F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.select(key, F.coalesce("text", F.md5(F.lit(""))).alias("text"), "page_count", "char_count", T.tokens(F.col("char_count")).alias("token_estimate"), "n_empty")


def status_of(rows: DataFrame) -> DataFrame:
    """Adds status, stage and error_code to documents with upload_error, scanned and char_count: a failure belongs to its row, not to the job."""
    error = F.coalesce("upload_error", F.when(F.col("scanned"), "SCANNED_PDF"))
    return rows.withColumn("error_code", error).withColumn("status", F.when(error.isNotNull(), "FAILED").when(F.col("char_count").isNull(), "EXTRACTING").otherwise("READY")).withColumn(
        "stage", F.when(error.isNotNull(), "Failed").when(F.col("char_count").isNull(), "Extracting text").otherwise("Ready"))


def _read_pages(rows: DataFrame) -> DataFrame:
    """What assemble_pages makes of the rows (schemas.RAW_PAGE, path, name, kind, whole, error) that are pages without an error, and all other columns of every row."""

    def run(batches):
        for rows in batches:
            page = rows.page_no.notna() & rows.error.isna()
            made = [assemble_page(list(i) if i is not None else [], h if h == h and h is not None else 0.0) if ok else (None, []) for ok, i, h in zip(page, rows["items"], rows["height"], strict=True)]
            yield rows.assign(text=[m[0] for m in made], items=[[dict(zip(PLACED, i, strict=True)) for i in m[1]] for m in made])[KEPT]

    return rows.mapInPandas(run, f"doc_id long, page_no int, width double, height double, text string, items array<{schemas.PAGE_ITEM}>, path string, name string, kind string, whole string, error string")


def ingested(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) of files as the source "documents" reads them.

    A Word or text file is its text: one page long, without page rows, ready at once. Page items become page texts with their
    offsets in the canonical text; a document of them without a text layer fails. A file that can't be read, or of which a page
    can't, fails as well; no failure is another row's. documents: doc_id, path, name, kind, text, page_count, char_count,
    token_estimate, status, stage, error_code, error_message. pages: schemas.PAGE and text. doc_id is a hash of the path.
    """
    rows = files.withColumn("doc_id", F.xxhash64("path"))
    # Files are opened and their items put together once: what is written has a row for each page, or for each file without.
    columns = [f.split()[0] for f in schemas.RAW_PAGE.split(", ", 4)]
    read = once(_read_pages(rows.select(*columns, "path", "name", "kind", F.col("text").alias("whole"), "error")))
    own = read.groupBy("doc_id").agg(F.any_value("path").alias("path"), F.any_value("name").alias("name"), F.any_value("kind").alias("kind"), F.max("whole").alias("whole"), F.min("error").alias("message"))
    pages = page_offsets(read.where("page_no is not null and error is null").select(*columns[:4], "text", "items"))
    made = canonical(pages).join(scan_check(pages).select("doc_id", "scanned"), "doc_id", "left")
    found = own.join(made, "doc_id", "left")
    text = F.coalesce("whole", "text")
    code = F.when(F.col("message").isNotNull(), F.when(F.col("message").startswith("Unsupported"), "UNSUPPORTED_TYPE").otherwise("FILE_CORRUPT")).when(F.col("scanned"), "NO_TEXT_LAYER")
    ready = code.isNull()
    chars = F.when(ready, F.length(text).cast("long"))
    documents = found.select(
        "doc_id", "path", "name", "kind", F.when(ready, text).alias("text"), F.when(ready, F.coalesce("page_count", F.lit(1))).cast("int").alias("page_count"), chars.alias("char_count"), T.tokens(chars).alias("token_estimate"),
        F.when(ready, "READY").otherwise("FAILED").alias("status"), F.when(ready, "Ready").otherwise("Can't read this file").alias("stage"), code.alias("error_code"),
        F.when(code == "NO_TEXT_LAYER", "no selectable text; OCR is not supported").otherwise(F.col("message")).alias("error_message"),
    )
    kept = pages.join(documents.where("status = 'READY'").select("doc_id"), "doc_id", "left_semi")
    return documents, kept.select(*(f.split()[0] for f in schemas.PAGE.split(", ", 6)), "text")

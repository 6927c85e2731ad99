"""Files as rows: text, Word documents, extracted page items, JSON, and events one to a line."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import schemas

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of all files below a folder, from the listing alone: contents are not read."""
    return files(spark, path).select("length").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def text_of(content: Column) -> Column:
    """UTF-8 with replacement of what isn't, without white space at the ends."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\s+|\s+$", "")


def _docx_root(content: bytes | None) -> ElementTree.Element | None:
    """The body of a Word document; None where the bytes are none."""
    try:
        return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def _shown(part: ElementTree.Element, revisions: bool) -> str:
    """The text below an element: with revisions inserted text counts and deleted text doesn't, without them the other way round."""
    skip = {id(t) for d in part.iter(f"{WORD}{'del' if revisions else 'ins'}") for t in d.iter()}
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n"}
    own = (f"{WORD}t",) if revisions else (f"{WORD}t", f"{WORD}delText")
    return "".join(marks.get(e.tag, e.text or "") for e in part.iter() if (e.tag in marks or e.tag in own) and id(e) not in skip)


def docx_paragraphs(content: bytes | None, revisions: bool = True) -> list[str] | None:
    """Texts of a Word document's paragraphs, tables included; None if it can't be read."""
    root = _docx_root(content)
    return None if root is None else [_shown(p, revisions) for p in root.iter(f"{WORD}p")]


@F.pandas_udf(StringType())
def docx_text(contents: pd.Series) -> pd.Series:
    """Paragraphs with text, one to a line; null if the document can't be read."""
    found = (docx_paragraphs(c) for c in contents)
    return pd.Series([None if x is None else "\n".join(t for t in x if t.strip()) for x in found], contents.index, object)


def _paragraph_html(p: ElementTree.Element, show: bool) -> str:
    style = p.find(f"{WORD}pPr/{WORD}pStyle")
    level = re.match(r"Heading([1-6])$", style.get(f"{WORD}val", "") if style is not None else "")
    tag = f"h{level[1]}" if level else "p"
    text = ""
    for child in p:
        mark = {f"{WORD}ins": "ins", f"{WORD}del": "del"}.get(child.tag)
        inner = escape("".join(t.text or "" for t in child.iter() if t.tag in (f"{WORD}t", f"{WORD}delText")))
        text += f"<{mark}>{inner}</{mark}>" if mark and show else "" if mark == "del" else inner
    return f"<{tag}>{text}</{tag}>"


def _block_html(parent: ElementTree.Element, show: bool) -> str:
    """Paragraphs and tables in their order; a table's cells hold blocks again."""
    out = []
    for child in parent:
        if child.tag == f"{WORD}p":
            out.append(_paragraph_html(child, show))
        elif child.tag == f"{WORD}tbl":
            rows = ("".join(f"<td>{_block_html(cell, show)}</td>" for cell in row.findall(f"{WORD}tc")) for row in child.findall(f"{WORD}tr"))
            out.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
    return "".join(out)


def docx_html(contents: Column | str, show_revisions: bool = True) -> Column:
    """Paragraphs and tables as HTML; null if the document can't be read. Inserted and deleted runs are marked, or taken as accepted."""

    @F.pandas_udf(StringType())
    def made(contents: pd.Series) -> pd.Series:
        roots = (_docx_root(c) for c in contents)
        return pd.Series([None if r is None else "".join(_block_html(body, show_revisions) for body in r.iter(f"{WORD}body")) for r in roots], contents.index, object)

    return made(contents)


def documents(found: DataFrame) -> DataFrame:
    """(path, name, kind, text, error) of files by suffix. A suffix that no reader has, or a Word document that can't be read, is an error of its row.

    PDF text comes from extracted items (see page_items): no PDF reader is part of this library.
    """
    name = name_of(F.col("path"))
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    rows = found.select("path", name.alias("name"), kind.alias("kind"), "content")
    text = F.when(F.col("kind").isin("txt", "md"), text_of(F.col("content"))).when(F.col("kind") == "docx", docx_text(F.when(F.col("kind") == "docx", F.col("content"))))
    unknown = F.when(~F.col("kind").isin("txt", "md", "docx"), F.concat(F.lit("Unsupported file type: "), "kind"))
    broken = F.when((F.col("kind") == "docx") & F.col("text").isNull(), F.lit("Unreadable Word document"))
    return rows.withColumn("text", text).withColumn("error", F.coalesce(unknown, broken)).drop("content")


def page_items(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages from JSON lines of already extracted items."""
    return spark.read.schema(schemas.RAW_PAGE).json(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of whole-file JSON arrays."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def answer_events(spark: SparkSession, path: str) -> DataFrame:
    """Events one to a line; lines that are no JSON are left out."""
    return spark.read.schema(schemas.ANSWER_EVENT).option("mode", "DROPMALFORMED").json(path).where("type is not null")


def parsed_events(buffers: DataFrame, key: str, schema: str = schemas.ANSWER_EVENT) -> DataFrame:
    """(key, ord, event) of the complete, well-formed lines of buffers (key, buffer); what follows the last line feed is rest_of()."""
    lines = F.split("buffer", "\n")
    rows = buffers.select(key, F.posexplode(F.slice(lines, 1, F.size(lines) - 1)).alias("ord", "line"))
    return rows.withColumn("event", F.from_json("line", schema)).where("event.type is not null").drop("line")


def rest_of(buffer: Column) -> Column:
    return F.element_at(F.split(buffer, "\n"), -1)


def byte_range(content: Column, first: Column, last: Column) -> Column:
    """Bytes first to last, both included; null where the range can't be met."""
    size = F.octet_length(content)
    return F.when((first >= 0) & (first < size) & (last >= first), F.substring(content, (first + 1).cast("int"), (F.least(last, size - 1) - first + 1).cast("int")))

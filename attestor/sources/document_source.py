"""Text, Word and page-item files as one Spark source, in batch and as a stream: spark.read.format("documents").load(folder).

A text or Word file is one row with its text and no page number; a file of extracted page items (JSON lines, one page each)
is a row for every page. What can't be read is a row with an error, so one bad file fails no job. Small files share a task
up to `partitionBytes`; page items are read line by line, so such a file may be of any length.

Conditions on path, name and kind decide which files are opened at all (spark.sql.python.filterPushdown.enabled), and files are
not opened where the columns asked for, .schema("path string, bytes long"), come from the listing.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .. import schemas
from .files import docx_paragraphs

LISTED = "path string, name string, kind string, bytes long, modified timestamp"
SCHEMA = f"{LISTED}, page_no int, text string, width double, height double, items array<{schemas.RAW_ITEM}>, error string"
ITEM = pa.struct([("str", pa.string()), ("transform", pa.list_(pa.float64())), ("width", pa.float64()), ("height", pa.float64()), ("has_eol", pa.bool_())])
ARROW = {
    "path": pa.string(), "name": pa.string(), "kind": pa.string(), "bytes": pa.int64(), "modified": pa.timestamp("us", "UTC"), "page_no": pa.int32(), "text": pa.string(),
    "width": pa.float64(), "height": pa.float64(), "items": pa.list_(ITEM), "error": pa.string(),
}
TEXTS, WORD, PAGES = ("txt", "md"), ("docx",), ("jsonl", "ndjson", "json")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, rows: list[dict]):
        self.rows = rows


def listed(path: str) -> list[dict]:
    """What the listing says of each file below a folder, or of one file. Names that begin with a dot or underscore are passed over."""
    store, below = _open(path)
    found = store.get_file_info(below)
    found = store.get_file_info(fs.FileSelector(below, recursive=True)) if found.type == fs.FileType.Directory else [found] if found.type == fs.FileType.File else []
    out = []
    for f in found:
        if f.type == fs.FileType.File and not re.search(r"/[._]", f.path.removeprefix(below)):
            kind = re.search(r"\.([A-Za-z0-9]+)$", f.base_name)
            out.append({"path": f.path, "name": f.base_name, "kind": kind[1].lower() if kind else "", "bytes": f.size, "modified": datetime.fromtimestamp(f.mtime_ns / 1e9, UTC)})
    return sorted(out, key=lambda r: r["path"])


def dealt(rows: Iterable[dict], size: int) -> list[Files]:
    """Files in order, as many to a task as size bytes hold; a larger file has a task of its own."""
    out: list[Files] = []
    held = size + 1
    for row in rows:
        if held + row["bytes"] > size:
            out.append(Files([]))
            held = 0
        out[-1].rows.append(row)
        held += row["bytes"]
    return out


def page_rows(stream: io.BufferedIOBase, row: dict) -> Iterator[dict]:
    for n, line in enumerate(stream, 1):
        if line.strip():
            try:
                page = json.loads(line)
                items = [{k: i.get(k) for k in ("str", "transform", "width", "height", "has_eol")} for i in page.get("items") or []]
                made = row | {"page_no": page.get("page_no") or n, "width": page.get("width"), "height": page.get("height"), "items": items}
                pa.RecordBatch.from_pylist([made], pa.schema(list(ARROW.items())))  # a value of a wrong type is an error of its row
                yield made
            except (ValueError, AttributeError, TypeError, pa.ArrowException) as e:
                yield row | {"page_no": n, "error": f"Unreadable page: {e}"[:200]}


def rows_of(store: fs.FileSystem, row: dict) -> Iterator[dict]:
    """The rows of one file."""
    if row["kind"] not in TEXTS + WORD + PAGES:
        yield row | {"error": f"Unsupported file type: {row['kind']}"}
        return
    try:
        with store.open_input_stream(row["path"], compression=None) as raw:
            if row["kind"] in PAGES:
                yield from page_rows(io.BufferedReader(raw), row)
            elif row["kind"] in TEXTS:
                yield row | {"text": raw.read().decode("utf-8", "replace").strip()}
            else:
                found = docx_paragraphs(raw.read())
                yield row | ({"error": "Unreadable Word document"} if found is None else {"text": "\n".join(p for p in found if p.strip())})
    except OSError as e:  # gone or locked since it was listed
        yield row | {"error": f"Unreadable file: {e}"[:200]}


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], size: int, batch: int = 1 << 22):
        self.path, self.columns, self.size, self.batch, self.wanted = path, columns, size, batch, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column in ("path", "name", "kind"):
                self.wanted.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        return dealt((r for r in listed(self.path) if all(r[c] in values for c, values in self.wanted)), self.size)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, ARROW[c]) for c in self.columns])
        store, _ = _open(self.path)
        opened = any(f"{c} " not in f"{LISTED}," for c in self.columns)
        rows, held = [], 0
        for row in partition.rows if partition else ():
            for made in rows_of(store, row) if opened else [row]:
                rows.append({c: made.get(c) for c in self.columns})
                held += 200 + len(made.get("text") or "") + 100 * len(made.get("items") or ())
                if held > self.batch:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class StreamReader(Reader, DataSourceStreamReader):
    """Files in the order of (modified, path): an offset is the last one taken. Files younger than `settle` seconds wait for the next batch."""

    def __init__(self, path: str, columns: list[str], size: int, settle: float):
        super().__init__(path, columns, size)
        self.settle = settle

    @staticmethod
    def _place(row: dict) -> list[str]:
        return [row["modified"].isoformat(timespec="microseconds"), row["path"]]

    def initialOffset(self) -> dict:
        return {"last": ["", ""]}

    def latestOffset(self) -> dict:
        until = datetime.now(UTC) - timedelta(seconds=self.settle)
        return {"last": max((self._place(r) for r in listed(self.path) if r["modified"] <= until), default=["", ""])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt((r for r in listed(self.path) if start["last"] < self._place(r) <= end["last"]), self.size)

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay, and Spark's log holds the offsets."""


class DocumentFiles(DataSource):
    """Options: path, partitionBytes (32 MB), settleSeconds (1; streams only)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def _columns(self, schema: StructType) -> list[str]:
        if unknown := set(schema.names) - set(ARROW):
            raise ValueError(f"no such columns: {sorted(unknown)}; there are {SCHEMA}")
        return schema.names

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self._columns(schema), int(self.options.get("partitionBytes", 32 << 20)))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], self._columns(schema), int(self.options.get("partitionBytes", 32 << 20)), float(self.options.get("settleSeconds", 1)))


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_documents(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    _registered(spark)
    return spark.read.format("documents").schema(columns).options(**options).load(path)


def stream_documents(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    _registered(spark)
    return spark.readStream.format("documents").schema(columns).options(**options).load(path)

"""Web archives (WARC 1.1) as a Spark source and sink, and archives without repeated payloads.

`spark.read.format("warc")` has a task for each archive and reads its records in a stream, one after the other, by their
lengths; `df.write.format("warc")` writes each task's records as gzip members into archives of bounded size, under a
temporary name until the whole job commits. Both work on any store that pyarrow's file systems reach.

Revisits are resolved over headers alone: digests and ids are shuffled, payloads are not. The smallest record of a digest
is its response, the others become revisit records with fresh headers that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote_from_bytes

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import Workspace, steady, with_totals

SCHEMA = "record_id string, type string, uri string, date string, digest string, refers_to string, refers_to_uri string, refers_to_date string, http string, payload binary"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
ARROW = pa.schema([(name, pa.binary() if name == "payload" else pa.string()) for name in FIELDS])
#: Header lines of the columns above, in the order in which they are written.
NAMES = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "uri": "WARC-Target-URI", "date": "WARC-Date", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "refers_to_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def header_value(value: str) -> str:
    """value with all that could end or split a header line percent-encoded."""
    return re.sub(r"[^!-~]+", lambda m: quote_from_bytes(m[0].encode("utf-8", "surrogatepass")), value)


def record(row: dict) -> bytes:
    """A record as it stands in an archive. A response's block is its HTTP header and payload, a revisit's its HTTP header alone."""
    payload = row["payload"] or b""
    block = (row["http"] or HTTP).encode() + b"\r\n\r\n" + (b"" if row["type"] == "revisit" else payload)
    lines = ["WARC/1.1"]
    for column, name in NAMES.items():
        value = row[column] or (NO_DATE if column == "date" else None)
        if value is not None:
            value = header_value(value)
            lines.append(f"{name}: " + (f"<{value}>" if column in ("record_id", "refers_to") else f"sha256:{value}" if column == "digest" and ":" not in value else value))
    if row["type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def plain_digest(digest: str | None) -> str | None:
    """A digest as the column has it: bare lower-case hex for SHA-256, algorithm:hex for others; from base 32 or hex."""
    if not digest:
        return None
    algorithm, _, value = digest.rpartition(":")
    algorithm = algorithm.lower() or "sha256"
    size = {"sha1": 20, "md5": 16}.get(algorithm, 32)
    if not (len(value) == 2 * size and re.fullmatch("[0-9A-Fa-f]+", value)):
        try:
            value = base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
        except ValueError:
            return digest  # of no known form: kept as it is
    return value.lower() if algorithm == "sha256" else f"{algorithm}:{value.lower()}"


def records(stream: io.BufferedIOBase, name: str = "") -> Iterator[dict]:
    """The response, resource and revisit records of an archive's plain bytes, one at a time. Raises on anything cut short."""
    while first := stream.readline():
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{name}: {first[:40]!r} is not the begin of a record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError(f"{name}: the archive ends within a header")
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{name}: the archive ends within a block of {length} bytes")
        if head.get("warc-type") not in ("response", "resource", "revisit"):
            continue
        row = {column: head.get(key.lower()) for column, key in NAMES.items()}
        row |= {k: (row[k] or "").strip("<>") or None for k in ("record_id", "refers_to")} | {"digest": plain_digest(row["digest"])}
        http, split, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
        row["http"], row["payload"] = http.decode("utf-8", "replace") or None, None if row["type"] == "revisit" else payload
        yield row


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


@dataclass
class Written(WriterCommitMessage):
    files: list


class Reader(DataSourceReader):
    def __init__(self, path: str, batch_bytes: int):
        self.path, self.batch_bytes = path, batch_bytes

    def partitions(self) -> list[Archive]:
        store, path = _open(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
            return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path) and "/_" not in f.path.removeprefix(path)]
        return [Archive(path)]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _open(self.path)
        with store.open_input_stream(partition.path, compression=None, buffer_size=1 << 20) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw)
            rows, held = [], 0
            for row in records(stream, partition.path):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > self.batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, size: int):
        self.path, self.overwrite, self.size, self.job = path.rstrip("/"), overwrite, size, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = _open(self.path)
        away = f"{path}/_temporary-{self.job}"
        store.create_dir(away, recursive=True)
        out, files = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{away}/{files[-1]}", compression=None)
                press = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member of its own, so that readers may start at any record
                out.write(press.compress(record(row)) + press.flush())
                if out.tell() > self.size:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", old.path):
                    store.delete_file(old.path)
        for name in (f for m in messages if m for f in m.files):
            store.move(f"{path}/_temporary-{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes what tasks left, those included that were lost or ran twice."""
        store, path = _open(self.path)
        if store.get_file_info(f"{path}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_temporary-{self.job}")


class Warc(DataSource):
    """Options: path; archiveBytes, after which a task begins a new archive (256 MB); batchBytes, of payloads read at a time (8 MB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("batchBytes", 8 << 20)))

    def writer(self, schema, overwrite: bool) -> Writer:
        missing = set(FIELDS) ^ set(schema.names)
        if missing:
            raise ValueError(f"columns of archives are {SCHEMA}; these differ: {sorted(missing)}")
        return Writer(self.options["path"], overwrite, int(self.options.get("archiveBytes", 256 << 20)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive or of all archives below a folder, in the columns of SCHEMA. A folder without archives has no rows."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").load(path)


def write_archives(records: DataFrame, path: str, **options: int) -> None:
    """Writes records (all columns of SCHEMA) as archives below path, beside those that are there."""
    records.sparkSession.dataSource.register(Warc)
    steady(records.sparkSession, 256)
    records.select(*FIELDS).write.format("warc").mode("append").options(**options).save(path)


def resolve_revisits(headers: DataFrame, least: int = 100) -> DataFrame:
    """Which records are revisits of which. headers: record_id, rank, type, uri, date, digest, n_bytes; best a written table.

    Of the responses with one digest and at least so many bytes that with the smallest rank (then id) stays, all others, and the
    revisit records of that digest whatever their length, refer to it. Returns record_id, digest, refers_to, refers_to_uri and
    refers_to_date, a row for each different (record_id, digest) that is to be a revisit. Records without id, rank or digest
    stay what they are, as do revisits whose response is not there. Rows that repeat an id, rank and digest stay alike.
    """
    sized = (F.col("n_bytes") >= least) | (F.col("type") == "revisit")
    known = headers.where("record_id is not null and rank is not null and digest is not null").where(sized)
    own = F.when(F.col("type") != "revisit", F.struct("rank", "record_id", "uri", "date"))
    found = with_totals(known.withColumn("own", own), ["digest"], "record_id", first=("own", F.min))
    again = found.where(F.col("first").isNotNull() & ((F.col("type") == "revisit") | (F.struct("rank", "record_id") > F.struct("first.rank", "first.record_id"))))
    return again.select("record_id", "digest", F.col("first.record_id").alias("refers_to"), F.col("first.uri").alias("refers_to_uri"), F.col("first.date").alias("refers_to_date")).dropDuplicates(["record_id", "digest"])


def archive_captures(captures: DataFrame, path: str, least: int = 100) -> DataFrame:
    """Writes captures (record_id, rank, uri, date, payload binary) as archives without repeated payloads below path and reads them back.

    The result is that of read_archives with resolved(): see there. A null payload counts as empty. Records with a null id have none
    in the archive and are responses. URIs and ids are percent-encoded where they could break a header line.
    """
    work = Workspace(captures.sparkSession, "warc")
    payload = F.coalesce("payload", F.lit(b""))
    rows = captures.select("record_id", "rank", "uri", "date", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    heads = work.keep(rows.select("record_id", "rank", "uri", "date", "digest", F.lit("response").alias("type"), F.octet_length("payload").cast("long").alias("n_bytes")), "headers")
    # A written table: where revisits are few Spark knows its size and sends it along, else both sides are shuffled by id.
    revisits = work.keep(resolve_revisits(heads, least), "revisits")
    both = rows.join(revisits, ["record_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    write_archives(both.select(
        "record_id", F.when(again, "revisit").otherwise("response").alias("type"), "uri", "date", "digest", "refers_to", "refers_to_uri", "refers_to_date",
        F.lit(None).cast("string").alias("http"), F.when(~again, F.col("payload")).alias("payload"),
    ), path)
    return resolved(read_archives(captures.sparkSession, path))


def resolved(archives: DataFrame) -> DataFrame:
    """record_id, type, uri, digest, n_bytes and refers_to of each record, with digests and lengths of full payloads.

    A response's are taken from its payload. A revisit's come from the response it refers to, which is found by id and digest; where
    that is not among the records its digest is its header's and n_bytes is null.
    """
    work = Workspace(archives.sparkSession, "warc")
    own = F.col("payload").isNotNull()
    heads = archives.select("record_id", "type", "uri", F.when(own, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("digest"), F.octet_length("payload").cast("long").alias("own_bytes"), F.coalesce(F.when(~own, F.col("refers_to")), "record_id", F.lit("")).alias("original"), F.when(~own, F.col("refers_to")).alias("refers_to"))
    heads = work.keep(heads.withColumn("digest", F.coalesce("digest", F.lit(""))), "read")
    found = with_totals(heads, ["original", "digest"], "record_id", n_bytes=("own_bytes", F.max))
    return found.select("record_id", "type", "uri", F.nullif("digest", F.lit("")).alias("digest"), "n_bytes", "refers_to")


def rewrite_archives(spark: SparkSession, source: str, target: str, least: int = 100) -> DataFrame:
    """Writes the archives below source again below target, without payloads that occur before, and returns resolved() of the result.

    Records rank by date, then id. A revisit of source is pointed to the response that stays for its digest, with fresh
    headers; where source has none it stays as it is.
    """
    work = Workspace(spark, "warc")
    rows = read_archives(spark, source)
    rows = rows.withColumn("digest", F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.col("digest")))
    heads = work.keep(rows.select("record_id", F.coalesce("date", F.lit("")).alias("rank"), "uri", "date", "digest", "type", F.octet_length("payload").cast("long").alias("n_bytes")), "headers")
    revisits = work.keep(resolve_revisits(heads, least).select("record_id", "digest", *(F.col(c).alias(f"new_{c}") for c in FIELDS if c.startswith("refers"))), "revisits")
    both = rows.join(revisits, ["record_id", "digest"], "left")
    again = F.col("new_refers_to").isNotNull()
    changed = {c: F.when(again, F.col(f"new_{c}")).otherwise(F.col(c)) for c in FIELDS if c.startswith("refers")} | {"type": F.when(again, "revisit").otherwise(F.col("type")), "payload": F.when(~again, F.col("payload"))}
    write_archives(both.select(*(changed.get(c, F.col(c)).alias(c) for c in FIELDS)), target)
    return resolved(read_archives(spark, target))

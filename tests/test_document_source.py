"""The source "documents": one format for all kinds of files, and what ingest makes of it."""

import json
import os

import pytest

from attestor.operators import ingest
from attestor.sources import document_source as source
from tests.test_streams_and_files import docx


def item(text, x=50.0, y=700.0):
    return {"str": text, "transform": [10.0, 0.0, 0.0, 10.0, x, y], "width": 6.0 * len(text), "height": 10.0, "has_eol": False}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("a.txt", b"  plain \xff words\n")
    put("sub/b.docx", docx("One", " ", "Two"))
    put("broken.docx", b"no zip")
    put("odd.xyz", b"?")
    put("none", b"")
    put("_hidden.txt", b"never")
    pages = [{"page_no": k + 1, "width": 600, "height": 800, "items": [item(f"This page {k + 1} has enough words to count as text, no doubt about it")]} for k in range(3)]
    put("c.jsonl", b"\n".join(json.dumps(p).encode() for p in pages) + b"\n")
    put("scan.jsonl", b"\n".join(json.dumps({"page_no": k + 1, "width": 600, "height": 800, "items": [item(".")]}).encode() for k in range(3)))
    put("cut.jsonl", json.dumps(pages[0]).encode() + b'\n{"page_no": 2, "items": [{"str"\n{"page_no": 3, "width": "wide"}\n')
    return str(tmp_path / "in")


def test_every_kind_through_one_format(spark, folder):
    rows = source.read_documents(spark, folder, partitionBytes=100).collect()
    got = {(r.name, r.page_no): r for r in rows}
    assert len(rows) == len(got) == 5 + 3 + 3 + 3
    assert got["a.txt", None].text == "plain � words" and got["b.docx", None].text == "One\nTwo\nin"
    assert got["broken.docx", None].error == "Unreadable Word document" and got["odd.xyz", None].error == "Unsupported file type: xyz" and got["none", None].error.startswith("Unsupported")
    assert got["c.jsonl", 2]["items"][0].str.startswith("This page 2") and got["c.jsonl", 2].height == 800
    assert got["cut.jsonl", 1].error is None and got["cut.jsonl", 2].error.startswith("Unreadable page") and got["cut.jsonl", 3].error.startswith("Unreadable page")
    assert source.read_documents(spark, folder + "/a.txt").count() == 1 and source.read_documents(spark, folder + "/missing").count() == 0


def test_unneeded_files_are_not_opened(spark, folder):
    os.chmod(f"{folder}/a.txt", 0)
    os.replace(f"{folder}/odd.xyz", f"{folder}/gone.txt")
    sizes = source.read_documents(spark, folder, "name string, bytes long")
    assert {r.name for r in sizes.collect()} >= {"a.txt", "gone.txt"}
    word = source.read_documents(spark, folder).where("kind = 'docx' and name in ('b.docx', 'broken.docx')")
    assert sorted(r.name for r in word.select("name", "error").collect()) == ["b.docx", "broken.docx"]
    reader = source.Reader(folder, ["name"], 1 << 20)
    left = list(reader.pushFilters([source.EqualTo(("kind",), "docx"), source.EqualTo(("error",), "x")]))
    assert [f.attribute for f in left] == [("error",)] and [r["name"] for p in reader.partitions() for r in p.rows] == ["broken.docx", "b.docx"]
    assert len(source.dealt([{"bytes": n} for n in (5, 5, 5, 20, 1)], 10)) == 4


def test_ingest_branches(spark, folder):
    documents, pages = ingest.ingested(source.read_documents(spark, folder))
    got = {r.name: r for r in documents.collect()}
    word = got["b.docx"]
    assert (word.status, word.page_count, word.text, word.char_count, word.token_estimate) == ("READY", 1, "One\nTwo\nin", 10, 3)
    assert {n: r.error_code for n, r in got.items()} == {"a.txt": None, "b.docx": None, "c.jsonl": None, "broken.docx": "FILE_CORRUPT", "odd.xyz": "UNSUPPORTED_TYPE", "none": "UNSUPPORTED_TYPE", "scan.jsonl": "NO_TEXT_LAYER", "cut.jsonl": "FILE_CORRUPT"}
    assert got["scan.jsonl"].text is None and got["c.jsonl"].page_count == 3
    rows = pages.orderBy("page_no").collect()
    assert [r.page_no for r in rows] == [1, 2, 3] and all(r.doc_id == got["c.jsonl"].doc_id for r in rows)
    assert all(got["c.jsonl"].text[r.char_start : r.char_end] == r.text for r in rows)


def test_files_stream_once_each(spark, folder, tmp_path):
    def run():
        q = source.stream_documents(spark, folder, "name string, text string", settleSeconds=0).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
        q.awaitTermination(120)
        return sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).where("text is not null").collect())

    assert run() == ["a.txt", "b.docx"] == run()
    with open(f"{folder}/later.txt", "w") as f:
        f.write("new words")
    assert run() == ["a.txt", "b.docx", "later.txt"]


def test_ingested_reads_files_once(spark, tmp_path, monkeypatch):
    """Files are opened by one pass, whatever follows reads what that wrote; pages, texts and failures keep what they held."""
    (tmp_path / "a.txt").write_text("A plain text that is long enough to be read as a document of its own.")
    (tmp_path / "b.jsonl").write_text('{"page_no": 1, "width": 10, "height": 20, "items": [{"str": "' + "x" * 60 + '", "transform": [1, 0, 0, 1, 2, 3], "width": 5, "height": 1, "has_eol": false}]}\n{"page_no": 2, "items": null}\n')
    (tmp_path / "c.jsonl").write_text("not json\n")
    files = source.read_documents(spark, str(tmp_path))
    documents, pages = ingest.ingested(files)
    plan = documents._jdf.queryExecution().optimizedPlan().toString() + pages._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "RelationV2" not in plan
    got = {r.name: (r.status, r.page_count, r.char_count, r.error_code) for r in documents.collect()}
    assert got == {"a.txt": ("READY", 1, 69, None), "b.jsonl": ("READY", 2, 62, None), "c.jsonl": ("FAILED", None, None, "FILE_CORRUPT")}
    assert [(r.page_no, r.char_start, r.char_end, r.text, len(r["items"])) for r in pages.orderBy("page_no").collect()] == [(1, 0, 60, "x" * 60, 1), (2, 62, 62, "", 0)]

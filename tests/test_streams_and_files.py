import io
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from attestor.operators import ingest, relations
from attestor.sources import files, sinks
from attestor.streaming import citations, events

SMALL = "/root/testdata/sf0.001"


def docx(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs) + "<w:p><w:ins><w:r><w:t>in</w:t></w:r></w:ins><w:del><w:r><w:delText>out</w:delText></w:r></w:del></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_become_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"  hello \xff\n")
    (tmp_path / "b.docx").write_bytes(docx("One", " ", "Two"))
    (tmp_path / "c.xyz").write_bytes(b"?")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    rows = {r.name: r for r in files.documents(files.files(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].text == "hello �" and rows["b.docx"].text == "One\nTwo\nin" and rows["d.docx"].text is None
    assert rows["d.docx"].error == "Unreadable Word document" and rows["b.docx"].error is None
    assert rows["c.xyz"].error == "Unsupported file type: xyz"
    assert files.folder_size(spark, str(tmp_path)).first().bytes == sum(p.stat().st_size for p in tmp_path.iterdir())
    html = spark.createDataFrame([(docx("A & B"),)], "c binary").select(files.docx_html("c").alias("h")).first().h
    assert html == "<p>A &amp; B</p><p><ins>in</ins><del>out</del></p>"


def test_word_tables_and_revisions_become_html(spark):
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    body = f"<w:tbl><w:tr>{cell.format('a')}{cell.format('b')}</w:tr></w:tbl><w:p><w:ins><w:r><w:t>in</w:t></w:r></w:ins><w:del><w:r><w:delText>out</w:delText></w:r></w:del></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    rows = spark.createDataFrame([(out.getvalue(),), (b"no zip",)], "c binary")
    shown, plain = (rows.select(files.docx_html("c", show)).collect() for show in (True, False))
    table = "<table><tr><td><p>a</p></td><td><p>b</p></td></tr></table>"
    assert [r[0] for r in shown] == [table + "<p><ins>in</ins><del>out</del></p>", None]
    assert plain[0][0] == table + "<p>in</p>"


def test_replaced_partitions_leave_others(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


@pytest.mark.parametrize("tokens,verified,want", [
    (["The cap is 5 [Q1].", " Notice [Q2]."], {"Q1", "Q2"}, "The cap is 5 [Q1]. Notice [Q2]."), (["In section 4 [", "Q", "1", "], so"], {"Q1"}, "In section 4 [Q1], so"),
    (["True [Q1]. False [Q2]."], {"Q1"}, "True [Q1]. False ."), (["False [", "Q99", "]."], {"Q1"}, "False ."), (["See [Annex A] and [b]."], {"Q1"}, "See [Annex A] and [b]."), (["Ends in [Q"], {"Q1"}, "Ends in "),
])
def test_citation_filter(spark, tokens, verified, want):
    held, out = "", ""
    for k, t in enumerate(tokens):
        text, held = citations.passed(held + t, verified, k == len(tokens) - 1)
        out += text
    assert out == want
    whole = spark.createDataFrame([("".join(tokens), sorted(verified))], "t string, v array<string>").select(citations.filtered_text(F.col("t"), F.col("v")).alias("x")).first().x
    assert whole == want


def test_streamed_answers_equal_whole_ones(spark, tmp_path):
    rows = [(1, 0, "a [", ["Q1"], False), (1, 1, "Q1] b [Q", ["Q1"], False), (2, 0, "x [Q7] y", None, True), (1, 2, "2] c [", ["Q1"], True)]
    for k in (0, 2):
        spark.createDataFrame(rows[k : k + 2], "message_id long, seq long, token string, verified array<string>, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message_id long, seq long, token string, verified array<string>, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = citations.answers(stream).writeStream.format("memory").queryName("said").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    said = {}
    for r in spark.table("said").orderBy("seq").collect():
        said[r.message_id] = said.get(r.message_id, "") + r.text
    assert said == {1: "a [Q1] b  c ", 2: "x  y"}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_event_streams(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    events.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination(60)
    total = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "log")).count() == total
    q = events.rates(stream, 60).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rates").agg(F.sum("count")).first()[0] == total
    done = []
    events.work_queue(stream, lambda rows: done.append(rows.count()), str(tmp_path / "c3")).awaitTermination(60)
    assert sum(done) == total


def test_page_assembly():
    item = lambda s, x, y, eol=False: {"str": s, "transform": [10.0, 0.0, 0.0, 10.0, x, y], "width": 6.0 * len(s), "height": 10.0, "has_eol": eol}
    text, items = ingest.assemble_page([item("Hello", 50, 700), item("world", 90, 700), item("next", 50, 680), item("", 0, 0), item("glued", 74, 680)], 800)
    assert text == "Hello world\nnextglued"
    assert items[0] == (0, 5, 50.0, 90.0, 30.0, 10.0) and items[1][0] == 6


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, relations.insert_absent(t, new, ["k"]).collect())) == [(3, "d")]
    hit, miss = relations.cached_or_missing(new.select("k").distinct(), t, ["k"])
    assert [r.k for r in hit.collect()] == [2] and [r.k for r in miss.collect()] == [3]
    sets = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (2, 5), (3, 5)], "k long, m long")
    assert [tuple(r) for r in relations.matching_sets(sets, "k", "m").collect()] == [(1, 2)]

"""Small column functions, each held to written-out values."""

import datetime

from pyspark.sql import functions as F

from attestor.functions import patterns as P
from attestor.functions import text as T
from attestor.operators import activity, ingest, redline


def values(spark, rows, schema, made):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(made).collect()]


def test_white_space_at_ends(spark):
    texts = [None, "", " ", P.SPACE_CHARS, f"{P.SPACE_CHARS}a b{P.SPACE_CHARS}", "\u200ba\x1c"]
    assert values(spark, [(t,) for t in texts], "t string", T.js_trim(F.col("t"))) == [None, "", "", "", "a b", "\u200ba\x1c"]
    by_pattern = F.regexp_replace("t", f"^{P.SPACE}+|{P.SPACE}+$", "")
    assert values(spark, [(t,) for t in texts], "t string", by_pattern.eqNullSafe(T.js_trim(F.col("t")))) == [True] * 6
    runs = F.regexp_replace("t", f"{P.SPACE}+", "_").eqNullSafe(F.regexp_replace("t", P.SPACE_RUN, "_")) & F.regexp_replace("t", f"{P.WS}+", "_").eqNullSafe(F.regexp_replace("t", P.WS_RUN, "_"))
    assert values(spark, [(t,) for t in texts], "t string", runs) == [True] * 6


def test_text_helpers(spark):
    assert values(spark, [("My Demo Org",), (None,)], "t string", T.plain_slug(F.col("t"))) == ["my-demo-org", None]
    fenced = [("```json\n{\"a\": 1}\n```",), ("```\n[1]\n```",), (" {} ",), ("",)]
    assert values(spark, fenced, "t string", T.unfenced(F.col("t"))) == ['{"a": 1}', "[1]", "{}", ""]
    wrapped = [('Sure: {"a": [1]} done',), ("see [1, 2] there",), ("none",)]
    assert values(spark, wrapped, "t string", T.outermost_json(F.col("t"))) == ['{"a": [1]}', "[1, 2]", ""]
    assert values(spark, [(0, 10), (1, 8), (10, 10)], "p int, n int", T.progress(F.col("p"), F.col("n"))) == [15, 23, 75]
    assert values(spark, [(0, 3), (2, 3)], "k int, n int", T.stepped(F.col("k"), F.col("n"), 1)) == [1, 0]
    assert values(spark, [(0, 3), (2, 3)], "k int, n int", T.stepped(F.col("k"), F.col("n"), -1)) == [2, 1]


def test_byte_sizes_round_ties_to_even(spark):
    sizes = [(1023,), (1024,), (2304,), (2816,), (2305,), (1 << 20,), (9 << 18,), (None,)]
    assert values(spark, sizes, "n long", T.byte_size(F.col("n"))) == ["1023 B", "1.0 KB", "2.2 KB", "2.8 KB", "2.3 KB", "1.0 MB", "2.2 MB", None]
    assert values(spark, [(1 << 20,)], "n long", T.byte_size(F.col("n"), "KB")) == ["1024.0 KB"]


def test_relative_times_count_parts_of_seconds(spark):
    now = F.lit("2024-02-02 00:00:00").cast("timestamp")
    then = [(datetime.datetime(2024, 1, 11, 0, 0, 0, 400_000),), (datetime.datetime(2024, 1, 11),), (datetime.datetime(2024, 2, 1, 23, 0, 0, 1),), (datetime.datetime(2024, 2, 1, 23),), (None,)]
    assert values(spark, then, "t timestamp", T.relative_time(F.col("t"), now)) == ["21d ago", "22d ago", "59m ago", "1h ago", None]


def test_roles_days_and_uploads(spark):
    roles = [("admin",), ("Lawyer",), ("paralegal",), ("guest",), (None,)]
    assert values(spark, roles, "r string", activity.role_at_least(F.col("r"), "lawyer")) == [True, True, False, False, None]
    days = [(datetime.datetime(2024, 5, d, 23, 59),) for d in (3, 2, 1)]
    assert values(spark, days, "t timestamp", redline.day_label(F.col("t"), F.lit("2024-05-03").cast("date"))) == ["Today", "Yesterday", "2024-05-01"]
    files = [("a.exe", None, 1), ("a.pdf", None, 10**9), ("a.pdf", "text/plain", 1), ("a.PDF", "application/pdf", 1), ("a.txt", "application/octet-stream", 1)]
    error = ingest.upload_error_py(F.col("n"), F.col("m"), F.col("s"))
    assert values(spark, files, "n string, m string, s long", error) == ["UNSUPPORTED_TYPE", "FILE_TOO_LARGE", "MIME_MISMATCH", None, None]


def test_reads_of_a_chunk_are_counted_once_without_copies_of_rows(spark):
    from attestor.operators import activity

    rows = [(1, 0, True), (1, 0, False), (1, 1, True), (1, 1, True), (1, 2, None), (1, None, True), (1, None, False), (2, 7, False), (2, 7, False), (2, 3, False), (None, 1, True)]
    made = activity.coverage(spark.createDataFrame(rows, "doc_id long, idx int, ok boolean"), spark.createDataFrame([(1, 2)], "doc_id long, n long"))
    assert "Expand" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.chunks_total, r.chunks_read, r.failed, r.complete, r.unreadable_pages) for r in made.collect()}
    assert got == {1: (3, 2, [0], False, 2), 2: (2, 0, [3, 7], False, 0), None: (1, 1, [], True, 0)}

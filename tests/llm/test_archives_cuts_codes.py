"""Operators 11 to 13 against plain versions, and on nulls, empty and repeated rows, clashing columns and empty tables."""

import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import fim, shared, vector_codes, warc

CAPTURE = "record_id string, rank long, uri string, date string, payload binary, digest string, type string"


# --- 11: archives ---


def captures(spark, rows):
    return spark.createDataFrame([(None if i is None else f"urn:page:{i}", i, u, None, p, "clash", "clash") for i, u, p in rows], CAPTURE)


def test_captures_become_archives_without_repeats(spark, tmp_path):
    big, other = b"x" * 100, b"y" * 99
    rows = [(5, "http://a/5", big), (3, "http://a/3", big), (9, None, big), (4, "u v\r\nWARC-Type: bad", other), (6, "http://a/6", other), (7, "http://é/7", None), (8, "", b""), (None, "http://n", big), (10, "w", b"WARC/1.1\r\n\r\n\r\n" * 20), (10, "w", b"WARC/1.1\r\n\r\n\r\n" * 20), (11, "b", bytes(range(256)))]
    got = warc.archive_captures(captures(spark, rows), str(tmp_path / "out")).collect()
    sha = lambda p: hashlib.sha256(p or b"").hexdigest()
    want = sorted((str(i), {5: "revisit", 9: "revisit"}.get(i, "response"), sha(p), len(p or b""), "urn:page:3" if i in (5, 9) else None) for i, _, p in rows)
    assert sorted(((r.record_id or "None").removeprefix("urn:page:"), r.type, r.digest, r.n_bytes, r.refers_to) for r in got) == want
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "out").glob("*.warc.gz"))
    assert raw.count(b"x" * 100) == 2 and len(list((tmp_path / "out").iterdir())) == len(list((tmp_path / "out").glob("*.warc.gz")))
    heads = {re.search(rb"WARC-Record-ID: <(.*?)>", h)[1]: h for h in re.findall(rb"WARC/1\.1\r\nWARC-Type.*?\r\n\r\n", raw, re.S) if b"Record-ID" in h}
    assert b"WARC-Refers-To: <urn:page:3>" in heads[b"urn:page:9"] and b"WARC-Refers-To-Target-URI: http://a/3" in heads[b"urn:page:9"] and b"identical-payload-digest" in heads[b"urn:page:9"]
    assert b"u%20v%0D%0AWARC-Type:%20bad" in heads[b"urn:page:4"] and b"http://%C3%A9/7" in heads[b"urn:page:7"]
    assert warc.archive_captures(captures(spark, rows).limit(0), str(tmp_path / "none")).count() == 0


def test_many_copies_and_small_archives(spark, tmp_path):
    rows = [(k, f"http://h/{k}", b"copy" * 50 if k % 3 else str(k).encode() * 60) for k in range(600)]
    got = {r.record_id: r for r in warc.archive_captures(captures(spark, rows).repartition(8), str(tmp_path / "out")).collect()}
    assert sum(r.type == "revisit" for r in got.values()) == 399 and {r.refers_to for r in got.values()} == {None, "urn:page:1"}
    warc.write_archives(warc.read_archives(spark, str(tmp_path / "out")), str(tmp_path / "small"), archiveBytes=2000)
    assert len(list((tmp_path / "small").glob("*.warc.gz"))) > 10
    again = warc.resolved(warc.read_archives(spark, str(tmp_path / "small"))).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got.values()), key=str)


def test_archives_of_others_are_rewritten(spark, tmp_path):
    def rec(kind, name, payload, date, extra="", digest=True):
        block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + payload
        sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(payload).digest()).decode()
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: http://{name}\r\n" + (f"WARC-Payload-Digest: {sha1}\r\n" if digest else "") + extra
        return head.encode() + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    page, sha = b"page " * 40, hashlib.sha256(b"page " * 40).hexdigest()
    (tmp_path / "in").mkdir()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "in/a.warc").write_bytes(info + rec("response", "late", page, "2024-02-02T00:00:00Z") + rec("response", "first", page, "2024-01-01T00:00:00Z", digest=False))
    known = f"WARC-Payload-Digest: sha256:{sha.upper()}\r\n"
    with gzip.open(tmp_path / "in/b.warc.gz", "wb") as f:
        f.write(rec("revisit", "again", b"", "2024-03-03T00:00:00Z", known + "WARC-Refers-To: <late>\r\n", False) + rec("revisit", "lost", b"", "2024-03-03T00:00:00Z", "WARC-Refers-To: <gone>\r\n"))
    got = {r.record_id: r for r in warc.rewrite_archives(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert {k: (r.type, r.refers_to, r.n_bytes) for k, r in got.items()} == {"first": ("response", None, 200), "late": ("revisit", "first", 200), "again": ("revisit", "first", 200), "lost": ("revisit", "gone", None)}
    assert {r.digest for k, r in got.items() if k != "lost"} == {sha}
    assert warc.read_archives(spark, str(tmp_path / "out")).where("http like '%X: y%'").count() == 4
    whole = rec("response", "x", page, "d")
    for cut in (len(whole) - 20, 60, 5):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(whole[:cut])))


def test_totals_reach_every_row(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))
    got = shared.with_totals(rows, ["key"], "id", low=("id", F.min), n=("id", F.sum)).collect()
    assert len(got) == 1000 and {(r.low, r.n) for r in got if r.key == "hot"} == {(0, sum(k for k in range(1000) if k % 10 < 8))}
    assert all(r.low == r.id == r.n for r in got if r.key != "hot")


# --- 12: fill-in-middle ---

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_plain_version(spark):
    r = random.Random(3)
    odd = [None, "", " ", "\n\t ", "a", " a", "a ", "é ü\x85 中　b", "has <P> in", "has <S> in", "has <M> in", "ends <", "<M <P S>", "a\x1cb\x0bc\x00d", "w " * 30_000, "z" * 20_000, " " * 20_000]
    texts = odd + ["".join(r.choice("ab <>PSMé\n\t中 ") for _ in range(r.randint(0, 80))) for _ in range(600)] + odd
    ids = [None if i == 40 else i - 5 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n long, output string")
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(x)[:6] for x in got), key=str) == sorted((plain_fim(i, t) for i, t in zip(ids, texts, strict=True)), key=str)
    back = {}
    for x in got:
        back.setdefault(x.doc_id, set()).add(x.back)
    assert back == {i: {t or ""} for i, t in zip(ids, texts, strict=True)}
    assert {x.form for x in got} == {"plain", "psm", "spm"} and fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 4096])
def test_chunks_find_every_boundary(size):
    r = random.Random(size)
    texts = [bytes(r.choice(b"ab \n") for _ in range(r.randint(0, 40))) for _ in range(50)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cut = fim.Chunks(data, offsets, size)
    for t, text in enumerate(texts):
        found = [m.end() for m in TOKEN.finditer(text.decode())]
        assert cut.n[t] == len(found)
        if text:
            assert [cut.place(t, k) - offsets[t] for k in range(len(found) + 1)] == [0, *found]


# --- 13: vector codes ---


def plain_codes(rows, size):
    """rows: (id, label, list) of kept vectors."""
    rows = sorted(rows, key=lambda r: r[0])
    x = np.array([[int(np.floor(1024 * float(c))) for c in v] for _, _, v in rows], np.int64)
    parts = np.split(x, 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def near(p, b):
        d = ((p[:, None] - b[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(4):
        for p, b in zip(parts, books, strict=True):
            best, _ = near(p, b)
            for e in range(len(b)):
                if (best == e).any():
                    b[e] = p[best == e].sum(0) // (best == e).sum()
    found = [near(p, b) for p, b in zip(parts, books, strict=True)]
    error = sum(f[1] for f in found)
    labels = [r[1] for r in rows]
    total = {k: int(sum(e for e, q in zip(error, labels, strict=True) if q == k)) for k in set(labels)}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{f[0][i]:02x}" for f in found), int(error[i]), total[r[1]]) for i, r in enumerate(rows)}, digest


@pytest.mark.parametrize("count,size", [(700, 16), (40, 8)])
def test_codes_equal_plain_version(spark, count, size):
    r = np.random.default_rng(count)
    x = r.normal(size=(count, size)).round(1)
    x[::7] = x[0]  # ties and repeats
    rows = [(3 * i - 20, None if i % 5 == 0 else i % 3, v.tolist()) for i, v in enumerate(x)]
    bad = [(-90, 1, None), (-91, 1, [1.0] * (size - 1) + [float("nan")]), (-92, 1, [1.0] * (size - 1) + [None]), (-93, 1, [float("-inf")] * size), (-94, 1, []), (None, 1, [1.0] * size), (9999, 1, [1.0] * (size + 4))]
    table = spark.createDataFrame([(i, v, k, "c", 0) for i, k, v in rows + bad], "vec_id long, embedding array<double>, label int, code string, id int").repartition(4)
    codes, books = vector_codes.compress(table)
    want, digest = plain_codes(rows, size)
    assert {q.vec_id: (q.code, q.error, q.label_error) for q in codes.collect()} == want and vector_codes.digest(books) == digest


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty, books = vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema))
    assert empty.count() == 0 and books.size == 0 and empty.columns == ["vec_id", "code", "error", "label_error"]
    codes, books = vector_codes.compress(spark.createDataFrame([(1, [1e30, -1e30, 0.5, 0.5, 1.0, 2.0], 1), (1, [1e30, -1e30, 0.5, 0.5, 1.0, 2.0], 2)], schema))
    assert [(q.code, q.error) for q in codes.collect()] == [("00000000", 0)] * 2 and books.shape == (4, 2, 2) and books.max() == vector_codes.LIMIT


def test_cells_bound_distances():
    r = np.random.default_rng(1)
    entries, x = r.integers(-3000, 3000, (256, 16)), r.integers(-9000, 9000, (50, 16))
    cells = vector_codes.Cells(entries)
    low, high = cells.bounds(x)
    exact = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()
    assert ((low <= high.min(1)[:, None]).sum(1) < 256).mean() > 0.5  # the filter leaves entries out
    best, d = cells.nearest(x)
    assert (best == exact.argmin(1)).all() and (d == exact.min(1)).all()

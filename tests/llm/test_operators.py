"""Each operator against a plain version, and on nulls, empty and repeated rows, clashing columns and empty tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import bpe_count, chat_format, cover_tree, decontaminate, line_dedup, line_quality, ngram_join, pii_spans, source_mix, url_lists

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, n int"
random.seed(4)
VOCABULARY = [a + b for a in "ka lo mi ru te so".split() for b in "na pe si du vo xi".split()]


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def edited(w: list[str], k: int, seed: int) -> list[str]:
    r, w = random.Random(seed), list(w)
    for i in r.sample(range(len(w)), k):
        w[i] = f"x{r.randint(0, 999)}"
    return w


def frame(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], len(t or ""), "r", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def components(ids, links):
    own = {i: i for i in ids}
    for a, b in list(links) * len(ids):
        low = min(own[a], own[b])
        if own[a] == own[b] == low:
            continue
        own[a] = own[b] = low
    return own


ODD = [None, "", " \n\t ", "one", "one two", "same text here twice over", "same text here twice over", "z" * 5000]


def test_ngram_join(spark):
    base = words(60, 1)
    texts = [*ODD, *(" ".join(edited(base, k % 5, k)) for k in range(30)), *(" ".join(words(50, 100 + k)) for k in range(20)), " ".join(base).upper()]

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    own = components(range(len(texts)), links)
    got = ngram_join.similar_documents(frame(spark, texts), words=4, num=85, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), own[i]) for i in range(len(texts))}
    assert ngram_join.similar_documents(frame(spark, [])).count() == 0
    assert [r.doc_id for r in ngram_join.similar_documents(frame(spark, ["a b c", "a b c", "q"], [5, 5, None])).collect()] == [5]


def test_sketch_bounds_the_intersection():
    r = np.random.default_rng(1)
    for _ in range(200):
        pool = r.integers(0, 2**64, 400, dtype=np.uint64)
        a, b = (np.unique(r.choice(pool, r.integers(1, 300))) for _ in range(2))
        x, y = ngram_join.sketch_of(a), ngram_join.sketch_of(b)
        assert x is None or y is None or ngram_join.bound(x, y) >= len(np.intersect1d(a, b))


def test_line_dedup(spark):
    long = words(40, 7)
    texts = [*ODD, " ".join(long) + "\nalone " + " ".join(words(30, 8)), "Intro, of its own\n" + " ".join(edited(long, 1, 3)).upper() + "!\n\n---", " ".join(long) + "\n" + " ".join(long)]
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert len(rows) == len(texts) and rows[0].text is None and rows[1].text == "" and rows[0].row == "r"
    assert rows[5].n_dropped == 0 and rows[6].n_dropped == 1 and rows[6].text == ""
    assert rows[8].text == texts[8] and rows[9].text == "Intro, of its own\n\n---" and rows[10].text == "" and rows[10].n_dropped == 2
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    twice = line_dedup.dedup_lines(frame(spark, ["a b c"] * 2, [1, 1])).collect()
    assert [r.text for r in twice] == ["a b c"] * 2


def test_word_edits_equal_a_plain_table():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i, *d[1:]], d
            for j, y in enumerate(b, 1):
                d[j] = min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y))
        return d[-1]

    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        assert line_dedup.edits(np.array(a, np.uint32), np.array(b, np.uint32)) == plain(a, b)


def test_decontamination(spark):
    items = [" ".join(words(30, 50 + k)) for k in range(6)]
    texts = [*ODD, items[0], " ".join(words(80, 60)) + " " + items[1].upper().replace(" ", ", ") + " " + " ".join(words(80, 61)), " ".join(edited(items[2].split(), 5, 1)), " ".join(words(200, 62)), " ".join(items[3].split()[:8])]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "one two")], "item_id long, text string")
    for size in (1_000_000, 40):  # one block, and one for each item
        got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.find_leaks(frame(spark, texts), bench, block_words=size).collect()}
        assert got == {i: {8: [0], 9: [1], 10: [2]}.get(i, []) for i in range(len(texts))}
    assert decontaminate.decontaminated(frame(spark, texts), bench).columns == DOCS.replace(",", "").split()[::2]
    assert decontaminate.find_leaks(frame(spark, ["a"]), bench.limit(0)).first().leaks == []
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0


def test_alignment_equals_a_plain_table():
    def plain(a, b):
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    r = np.random.default_rng(3)
    a, b = ([r.integers(5, 9, r.integers(1, n)).astype(np.uint64) for _ in range(60)] for n in (12, 20))
    assert decontaminate.align(a, b).tolist() == [plain(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_mix(spark):
    sources = ["a", "b", None, "c", "a", "b", "d", "a"] * 40
    texts = [" ".join(words(random.Random(i).randint(0, 90), i)) for i in range(len(sources))]
    texts[0], texts[1] = None, "big " * 900
    rows = source_mix.mix_sources(frame(spark, texts, None, sources)).toPandas()
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert dict(zip(rows.doc_id, rows["size"])) == size and len(rows) == len(texts)
    assert (rows.taken <= 2 * rows["size"]).all()
    by = rows.assign(source=rows.source.fillna("~")).groupby("source").agg(S=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by.S == by.source_size).all()
    names = [*sorted(s for s in by.index if s != "~"), "~"]
    left, weight, want = 1.5 * by.S.sum(), {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}
    while True:
        level = left / sum(weight.values())
        over = [s for s in weight if weight[s] * level > 2 * by.S[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * by.S[s]
            left -= want[s]
            del weight[s]
    want |= {s: w * level for s, w in weight.items()}
    assert all(abs(by.target[s] - want[s]) < 1e-6 * max(1, want[s]) for s in names)
    assert all(abs(by.taken[s] - want[s]) <= 0.03 * want[s] for s in names)
    again = source_mix.mix_sources(frame(spark, texts, None, sources).repartition(7)).toPandas()
    assert dict(zip(rows.doc_id, rows.copies)) == dict(zip(again.doc_id, again.copies))
    assert source_mix.mix_sources(frame(spark, [])).count() == 0
    tilted = source_mix.mix_sources(frame(spark, texts, None, sources), prior=F.col("doc_id") % 2 * 0.5 + 0.5).toPandas()
    t = tilted.assign(source=tilted.source.fillna("~")).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert all(abs(t.taken[s] - t.target[s]) <= 0.05 * t.target[s] for s in names)


def test_scores_do_not_depend_on_batches_or_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    field = line_quality.fit_quality(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), steps=20)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    try:
        for rows, parts in ((1, 1), (7, 13), (1000, 1), (1000, 13)):
            spark.conf.set(key, str(rows))
            seen.append({r.doc_id: r.score for r in line_quality.score_quality(docs.repartition(parts), field).collect()})
    finally:
        spark.conf.set(key, before)
    assert len(seen[0]) > 100 and all(s == seen[0] for s in seen)


def test_quality(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = line_quality.fit_quality(rows, labels, steps=40)
    got = line_quality.score_quality(rows, field).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert len(got) > 50 and ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.9
    odd = {r.doc_id: r for r in line_quality.score_quality(frame(spark, ODD), field).collect()}
    assert [odd[i].score for i in (0, 1)] == [0.0, 0.0] and all(0 <= r.score <= 1 for r in odd.values()) and odd[5].score == odd[6].score
    none = line_quality.line_quality(frame(spark, ODD), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0, 0.5}
    assert line_quality.score_quality(frame(spark, []), field).count() == 0


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(5)
    field = line_quality.Field(r.normal(size=(10, 3)))
    field.move = r.normal(size=(2, 2))
    begin = np.array([0, 3, 3, 4, 8])
    score = r.normal(size=8)
    good, _, total = field.marginals(score, begin)
    for a, b, z in zip(begin, begin[1:], total):
        if a == b:
            continue
        weights = {}
        for y in np.ndindex(*[2] * (b - a)):
            weights[y] = np.exp(sum(score[a + t] * y[t] for t in range(b - a)) + sum(field.move[y[t], y[t + 1]] for t in range(b - a - 1)))
        all_ = sum(weights.values())
        assert abs(np.log(all_) - z) < 1e-9
        for t in range(b - a):
            assert abs(good[a + t] - sum(w for y, w in weights.items() if y[t]) / all_) < 1e-9


def test_personal_data(spark):
    text = "Mail jo.x@mail.example.com, 10.0.300.1 and 10.0.0.1; 4111 1111 1111 1111, +1 (212) 555-0187. jane [at] corp [dot] com 1.2.3"
    texts = [*ODD, text, "é " + text, *(f"Contact: p{i} [at] host{i} [dot] com or call (212) 555-01{i:02d}" for i in range(30))]
    rows = {r.doc_id: r for r in pii_spans.find_personal_data(frame(spark, texts)).collect()}
    r = rows[8]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    spans = [s.split(":") for s in r.spans.split(",")]
    assert [text[int(a) : int(b)] for k, a, b in spans] == ["jo.x@mail.example.com", "10.0.0.1", "4111 1111 1111 1111", "+1 (212) 555-0187", "jane [at] corp [dot] com"]
    assert [int(s.split(":")[1]) for s in rows[9].spans.split(",")] == [int(a) + 2 for _, a, _ in spans]
    assert rows[0].spans == "" and rows[0].base_sha256 == rows[1].base_sha256
    assert pii_spans.find_personal_data(frame(spark, [])).count() == 0


def test_base_spans_equal_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("@@..01925 2-+()aZ_é\n") for _ in range(r.randint(0, 40)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii_spans.base_spans(t) if s[1] < 2] == sorted(want)


def test_reliabilities_tell_good_labelers_from_bad():
    r = np.random.default_rng(0)
    true = r.random(4000) < 0.4
    votes = np.stack([np.where(r.random(4000) < p, np.where(true, 1, -1), np.where(true, -1, 1)) for p in (0.95, 0.9, 0.85, 0.6)], 1)
    given, share, p = pii_spans.reliabilities(votes, np.ones(4000))
    assert ((p > 0.5) == true).mean() > 0.95 and abs(share - 0.4) < 0.05 and given[0, 1, 2] > given[3, 1, 2]


def test_url_lists(spark):
    captures = spark.createDataFrame([(1, "http://a.b.example.com:80/x/?q#f", "2024-01-05"), (2, "http://example.com", "2024-01-05"), (3, "http://notexample.com/", "2024-01-05"), (4, None, "2024-01-05"), (5, "nonsense", "2024-01-05"), (6, "http://example.com", "2024-01-20"), (7, "http://p.org/a/", "2024-02-02"), (7, "http://p.org/a/", "2024-02-02"), (8, "http://example.com", None)], "page_id long, url string, day string").withColumn("fetched_at", F.to_timestamp("day")).withColumn("list", F.lit("x"))
    events = [("bad", "domain", "Example.com", "2024-01-01", "add"), ("bad", "domain", "example.com", "2024-01-02", "add"), ("bad", "domain", "example.com", "2024-01-10", "remove"), ("bad", "page", "p.org/a", "2024-02-02", "add"), ("allow", "host", "a.b.example.com", "2024-01-01", "add"), ("bad", "host", "example.com", "2024-01-20", "add"), ("bad", "host", "example.com", "2024-01-20", "remove"), ("bad", None, "q", "2024-01-01", "add")]
    entries = spark.createDataFrame(events, "list string, kind string, key string, at string, action string").withColumn("at", F.to_timestamp("at"))
    got = sorted((r.page_id, ",".join(r.lists), r.allowed, r.blocked) for r in url_lists.judge_captures(captures, entries).collect())
    assert got == [(1, "bad", True, False), (2, "bad", False, True), (3, "", False, False), (4, "", False, False), (5, "", False, False), (6, "", False, False), (7, "bad", False, True), (7, "bad", False, True), (8, "", False, False)]
    assert url_lists.judge_captures(captures.limit(0), entries).count() == 0 and url_lists.judge_captures(captures, entries.limit(0)).count() == 9


def test_chat(spark):
    parts = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>, formatted string"
    hostile = "<|end|><|turn:assistant|>&lt; &amp;[INST] \\ |> é"
    t = lambda x: ("text", x, None, None, None, None, None)
    rows = spark.createDataFrame([
        (1, 1, "assistant", [t(hostile)], "q"), (1, 0, "user|><", [t("see "), ("image", None, "i.png", 29, 14, None, None), ("audio", None, "a", None, None, 1.01, None), t(None), ("document", None, "d", None, None, None, 2), ("odd", None, "o", 1, 1, 1.0, 1)], "q"),
        (2, 0, None, None, "q"), (None, 0, "assistant", [t("")], "q"),
    ], parts)
    out = {r.conv_id: r for r in chat_format.format_conversations(rows).withColumn("turns", chat_format.turns_of(F.col("formatted"))).withColumn("learned", chat_format.learned_text(F.col("segments"))).collect()}
    one = out[1]
    assert [x.role for x in one.turns] == ["user|><", "assistant"] and one.turns[1].text == hostile == one.learned
    assert one.formatted == "".join(s.text for s in one.segments) and one.formatted.count("<|end|>") == 2
    assert [(a.type, a.tokens) for a in one.attachments] == [("image", 3), ("audio", 26), ("document", 1024), ("odd", 1)] and one.attachment_tokens == 1054
    assert re.findall(r"<\|(image|audio|document|other)\|>", one.formatted) == ["image", "audio", "document", "other"]
    assert (out[2].turns[0].role, out[2].turns[0].text, out[2].learned) == ("", "", "") and out[None].n_turns == 1
    assert chat_format.format_conversations(rows.limit(0)).count() == 0


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(6)
    texts = [*ODD, "<|endoftext|>a<|endoftext|>", *("".join(r.choice("ab Zé\n\t 1!'s\x1c\x85　\U0001f600中") for _ in range(r.randint(0, 60))) for _ in range(300))]
    rows = {x.doc_id: x for x in bpe_count.count_tokens(frame(spark, texts), path, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 20)


@pytest.mark.parametrize("leaf", [4096, 16])
def test_near_vectors(spark, leaf):
    r = np.random.default_rng(7)
    centre = r.normal(size=(6, 8))
    x = np.concatenate([centre[k % 6] + 0.25 * r.normal(size=8) for k in range(150)]).reshape(150, 8).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, x[3].tolist()), (201, [0.0] * 8), (202, None), (203, [1.0] * 7 + [float("nan")]), (204, [1.0] * 7 + [None]), (205, (2 * x[5]).tolist()), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [])]
    got = {q.vec_id: q for q in cover_tree.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, raw int"), leaf=leaf).collect()}
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    own = components([i for i, _ in rows], links)
    assert {i: (q.n_links, q.component_id, q.kept) for i, q in got.items()} == {i: (sum(i in p for p in links), own[i], own[i] == i) for i, _ in rows}

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import views
from attestor.operators.chunks import char_chunks, cut_text, word_chunks


def plain_keep(text):
    """The keep view and its map, character by character; the map has one entry more than the view, the length of the source."""
    out, at, gap = [], [], None
    for c, i in views.compatible(text):
        for d in views._FOLD.get(ord(c), c):
            if d in views._WHITE:
                gap = i if gap is None else gap
                continue
            if gap is not None and out:
                out.append(" ")
                at.append(gap)
            gap = None
            out.append(d)
            at.append(i)
    return "".join(out), [*at, len(text)]


def plain_join(s, at):
    drop = {j for k in range(1, len(s) - 2) if s[k] == "-" and s[k + 1] == " " and s[k - 1].isalpha() and unicodedata.category(s[k + 2]) == "Ll" for j in (k, k + 1)}
    return "".join(c for k, c in enumerate(s) if k not in drop), [a for k, a in enumerate(at) if k not in drop]


def plain_loose(s, at):
    return s.replace(" ", ""), [a for k, a in enumerate(at) if s[k : k + 1] != " "]


def spread(view):
    """A view's string and its map, place by place."""
    return view[0], [views.source_of(view[1], view[2], k) for k in range(len(view[0]) + 1)]


def test_keep_view_and_map():
    assert spread(views.keep_of("a   b")) == ("a b", [0, 1, 4, 5])
    assert views.keep_of("“ofﬁce” – ok…")[0] == '"office" - ok...'
    assert views.keep_of("x­​y  z ")[0] == "xy z"


def test_join_view():
    join = lambda t: views.join_of(*views.keep_of(t))[0]
    assert join("termi- nated and re- structured") == "terminated and restructured"
    assert join("Non- Exclusive") == "Non- Exclusive"
    assert join("- value") == "- value" and join("co-operation") == "co-operation"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abÉ- \n\t- ’ﬁéé​X…①\U0001f600中")), max_size=40))
def test_maps_in_runs_equal_maps_by_character(text):
    keep, plain = views.keep_of(text), plain_keep(text)
    assert spread(keep) == plain
    assert spread(views.join_of(*keep)) == plain_join(*plain) and spread(views.loose_of(*keep)) == plain_loose(*plain)
    assert plain[1] == sorted(plain[1]) and plain_keep("".join(unicodedata.normalize("NFKC", c) for c in text))[0] == plain[0]


def test_maps_grow_with_changes_only():
    text = "plain words of any number, " * 20_000
    assert [len(x) for x in views.keep_of(text)[1:]] == [2, 2]  # one run, and the trailing space that is not kept
    assert len(views.keep_of("ofﬁce  of \n" * 100)[1]) <= 401


def test_native_views_equal_the_mapped_ones(spark):
    texts = ["A  b- c—d “q”…", "", "x- y z- Q", "fiﬁ- n", "a　 b"]
    rows = views.with_views(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = rows.withColumn("k", T.keep_view(views.nfkc("text"))).withColumn("j", T.join_view(F.col("k"))).withColumn("l", T.loose_key(F.col("k")))
    for r in rows.collect():
        assert (r.keep.s, r.join.s, r.loose.s) == (r.k, r.j, r.l)


def test_find_all_overlaps_and_stops_at_fifty(spark):
    r = spark.createDataFrame([("aaaa", "aa"), ("a" * 100, "a"), ("b", ""), (None, "x")], "t string, n string").select(views.find_all(F.col("t"), F.col("n")).alias("at")).collect()
    assert [list(x.at) for x in r][0] == [0, 1, 2] and len(r[1].at) == 50 and not r[2].at and not r[3].at


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_char_chunks_cover_the_text(text, most, overlap):
    cuts = cut_text(text, most, overlap)
    if not text:
        assert cuts == []
        return
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (s, e), (s2, _) in zip(cuts, cuts[1:]):
        assert s < s2 <= e and e - s <= most


def test_char_chunks_are_slices(spark):
    docs = spark.createDataFrame([(1, "para one.\n\n" * 40), (2, ""), (3, None), (4, "A" * 1000)], "doc_id long, text string")
    rows = char_chunks(docs, 50, 5).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == {1, 4}
    assert all(r.text == texts[r.doc_id][r.char_start : r.char_end] for r in rows)


def test_word_chunks(spark):
    pages = spark.createDataFrame([(1, 1, " ".join(f"w{i}" for i in range(25))), (1, 2, "one two three four five"), (1, 3, " \n ")], "doc_id long, page_no int, text string")
    rows = word_chunks(pages, 10, 3).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert [r.n_words for r in rows if r.page == 1] == [10, 10, 10, 4] and [r.n_words for r in rows if r.page == 2] == [5]


def test_keys(spark):
    rows = spark.createDataFrame([("Section 1. The  Fee, 5.00",), ("Provider shall pay",), ("Customer shall pay",)], "t string").select(T.cosmetic_key(F.col("t")).alias("c"), T.title_key(F.col("t")).alias("t")).collect()
    assert rows[1].c == rows[2].c == "shall pay"
    assert rows[0].t == "section 1 the fee 500"


def test_section_points_count_hits_without_patterns_and_windows_leave_words_behind(spark):
    import re

    from attestor.operators import retrieve

    texts = ["days", "DAYS daysdays days,days.", "days" * 20, "days eren-ing\nings ing", "", "d\U0001f600ays \U0001f600days\U0001f600days", "30 days ther eder section 4"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, text string")
    asked = spark.range(1).select(retrieve.concepts(F.lit("about days, eren-ing or section 4")).alias("asked"))
    made = rows.crossJoin(asked).select("n", "text", "asked", retrieve.chunk_score(F.col("text"), F.col("asked")).alias("score"))
    assert "regexp_count" not in made._jdf.queryExecution().optimizedPlan().toString()
    for r in made.collect():
        low, q = r.text.lower(), r.asked
        hit = {k: [x for x in q[k] if x in low] for k in ("terms", "phrases", "entities")}
        share = sum(map(len, hit.values())) / len(q.terms)
        want = 15 * len(hit["entities"]) + 12 * len(hit["phrases"]) + sum(3 + 0.5 * min(5, len(re.findall("(?s)" + re.escape(t) + ".?", low))) for t in hit["terms"]) + 10 * (share >= 0.6) + 15 * (share >= 0.8)
        assert r.score == want
    page = spark.createDataFrame([(1, 1, " ".join(map(str, range(1000))))], "doc_id long, page_no int, text string")
    made = word_chunks(page, 200, 50)
    assert "Generate explode(transform(" in made._jdf.queryExecution().optimizedPlan().toString() and [r.n_words for r in made.orderBy("chunk_index").collect()] == [200] * 6 + [100]

"""clause_search asks every ready-made search, and finds what it must by comparing all."""

import numpy as np

from attestor.functions.catalogue import clause_catalogue
from attestor.operators.embed import hashed_words
from attestor.operators import chunks
from attestor.plans import text_queries
from tests.oracle import SMALL


def test_every_search_of_the_catalogue_finds_its_nearest_chunks(spark):
    asked = clause_catalogue(spark).selectExpr("id", "posexplode(queries) as (k, text)").selectExpr("concat_ws('-', id, k) as query_id", "text")
    asked = {r.query_id: np.array(r.v) for r in asked.select("query_id", hashed_words(asked.text).alias("v")).collect()}
    parts = chunks.word_chunks(text_queries.pages_of(spark, SMALL)).selectExpr("doc_id * 100000 + chunk_index as vec_id", "text")
    parts = sorted((r.vec_id, r.v) for r in parts.select("vec_id", hashed_words(parts.text).alias("v")).collect())
    parts = [(k, np.array(v)) for k, v in parts if any(v)]
    want = set()
    for name, q in asked.items():
        best = sorted((-max(0.0, round(float(1 + q @ v) / 2, 4)), k) for k, v in parts)[:5]
        want |= {(name, place, k) for place, (_, k) in enumerate(best, 1)}
    got = {(r.query_id, r.place, r.vec_id) for r in text_queries.clause_search(spark, SMALL).collect()}
    assert len(asked) == 31 and got == want

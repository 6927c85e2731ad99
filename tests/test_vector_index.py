"""Nearest vectors against all products, and how many vectors are opened for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import vector_index as V


def plain(vectors, queries, k):
    out = set()
    good = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, u in queries:
        if u is None or not np.any(u):
            continue
        u = np.array(u, float) / np.linalg.norm(u)
        rows = sorted((-max(0.0, float(np.round((1 + v @ u) / 2, 4))), i) for i, v in good if len(v) == len(u))
        out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(rows[:k])}
    return out


@pytest.mark.parametrize("spread,most", [(0.05, 0.35), (5.0, 1.0)])
def test_equal_to_all_products(spark, monkeypatch, spread, most):
    monkeypatch.setattr(V, "PART", 100)
    monkeypatch.setattr(V, "BLOCK", 7)
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 16))
    x = [(i, (centre[i % 12] + spread * r.normal(size=16)).tolist()) for i in range(1500)]
    x += [(2000 + i, x[5][1]) for i in range(40)]  # ties
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [1.0] * 15 + [float("nan")]), (3003, [1.0] * 15 + [None]), (3004, [1.0] * 3)]
    asked = [(-i, x[i * 60][1]) for i in range(25)] + [(-100, None), (-101, [0.0] * 16), (-102, (-centre[0]).tolist())]
    vectors = spark.createDataFrame(x + odd, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    index = V.VectorIndex(vectors)
    got = {(q.query_id, q.vec_id, q.score, q.place) for q in index.search(queries, 15).collect()}
    assert got == plain(x + odd, asked, 15)
    first, _, later = index.opened(queries, 15)
    n = spark.createDataFrame(index.facts[["list", "n"]])
    share = sum(p.join(n, "list").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for p in (first, later)) / (len(x) * 26)
    assert share <= most and len(index.facts) > 5


def test_few_and_none(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, query array<float>")
    assert [(q.vec_id, q.score) for q in V.VectorIndex(vectors).search(queries, 5).orderBy("place").collect()] == [(1, 0.8536), (2, 0.8536)]
    assert V.VectorIndex(vectors.limit(0)).search(queries, 5).count() == 0 and V.VectorIndex(vectors).search(queries.limit(0), 5).count() == 0

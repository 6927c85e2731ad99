"""Pairs of versions are compared in shares: with the same rows, and nothing of a share is left on disk but them."""

import os

from attestor import lineage
from attestor.plans import text_queries
from tests.oracle import SMALL, expected, rows


def shelves(spark) -> set[str]:
    return {x for x in os.listdir(lineage.shared_folder(spark).removeprefix("file:")) if x.startswith("shelf-")}


def test_versions_in_three_shares(spark, monkeypatch):
    n = text_queries.docs(spark, SMALL).count()
    monkeypatch.setattr(lineage, "EACH", -(-n // 3))
    before = shelves(spark)
    got = text_queries.aligned_changes(spark, SMALL).toPandas()
    assert rows(got) == rows(expected(text_queries.ORACLE["aligned_changes"]))
    assert len(shelves(spark) - before) == 1


def test_shares_hold_every_row_once_null_keys_too(spark, monkeypatch):
    monkeypatch.setattr(lineage, "EACH", 10)
    given = spark.range(75).selectExpr("nullif(id, 7) AS k", "id")
    seen = []

    def work(share, once):
        seen.append(once(share).count())
        return once(share)

    assert sorted(r.id for r in lineage.in_shares(given, "k", work).collect()) == list(range(75))
    assert len(seen) == 8 and sum(seen) == 75


def test_documents_are_compared_alike_in_any_number_of_shares(spark, monkeypatch):
    whole = sorted(map(str, text_queries.compare_documents(spark, SMALL).collect()))
    monkeypatch.setattr(lineage, "EACH", len(whole) // 2)
    before = shelves(spark)
    assert sorted(map(str, text_queries.compare_documents(spark, SMALL).collect())) == whole
    assert len(shelves(spark) - before) == 1

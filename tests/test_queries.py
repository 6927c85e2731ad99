import importlib
import sys

import pytest

from attestor.plans import queries as own
from tests.oracle import SMALL, expected, rows

#: Whole programs, which run on the smaller tables here.
PROGRAMS = {"ask_documents", "compare_documents", "clause_search"}


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_matches_sql(spark, name):
    got, want = own.QUERIES[name](spark, SMALL).toPandas(), expected(own.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE)))
def test_runs(spark, name):
    assert own.QUERIES[name](spark, SMALL if name in PROGRAMS else SMALL.replace("0.001", "0.01")).count() > 0


def test_entry_survives_without_the_corpus_subpackage(spark, monkeypatch):
    for name in [m for m in sys.modules if m.startswith("attestor.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "attestor.llm", None)
    e = importlib.import_module("__spark_entry__")
    assert e.llm is None and set(e.queries()) == set(own.QUERIES) and set(e.oracle_sql()) == set(own.ORACLE)
    assert e.entry(spark).columns == ["item_id", "n_docs", "status"]
    monkeypatch.delitem(sys.modules, "__spark_entry__")

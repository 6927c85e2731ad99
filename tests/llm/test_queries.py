import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import queries as llm
from tests.oracle import SMALL, expected, rows


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_matches_sql(spark, name):
    got, want = llm.QUERIES[name](spark, SMALL).toPandas(), expected(llm.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES if n != "pipeline") == list(range(1, 14))


def test_pipeline_keeps_columns_and_takes_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9_000_001, "", "en", "src1", 0), (None, "words of a row without an id, kept as it is written here", "en", None, 1)], docs.schema)
    now = docs.unionByName(odd).unionByName(docs.limit(3))
    before = now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL)
        assert after.columns == docs.columns, name
        now = after.checkpoint()
        assert 0 < now.count() <= before
        before = now.count()
    assert now.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.agg(F.max("copy")).first()[0] <= 2

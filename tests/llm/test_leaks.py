"""An item is found in every document that holds enough of it, however many documents do."""

import pytest
from pyspark.sql import functions as F

from attestor.llm import decontaminate


@pytest.mark.parametrize("copies", [15, 25, 300])
def test_a_passage_in_many_documents_is_found_in_each(spark, copies):
    item = [f"w{k}" for k in range(40)]
    part, near = " ".join(item[:24]), " ".join("other" if k in (5, 30) else w for k, w in enumerate(item))
    texts = [(i, f"before {i} it {part} after {i}") for i in range(copies)] + [(copies, near), (copies + 1, "w1 w2 w3 alone"), (copies + 2, " ".join(item[:20]))]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, "one short item of six")], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.find_leaks(docs, items).where(F.size("leaks") > 0).collect()}
    assert got == set(range(copies + 1))


def test_a_short_item_with_one_rare_seed_is_found(spark):
    """Two of its three seeds stand in many documents, the third in one."""
    texts = ["a b c d x"] * 40 + ["a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).where(F.size("leaks") > 0)
    assert {r.doc_id for r in got.collect()} == set(range(41))

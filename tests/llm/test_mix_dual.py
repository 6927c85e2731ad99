"""The dual behind the mix: it ends, rates are tilted as it says, and what is out of reach raises."""

import math

import pytest
from pyspark.sql import functions as F

from attestor.llm import source_mix


def documents(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 3}", 0.3 + (i * 7 % 90) / 60) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")


def test_rates_are_tilted_exponentially(spark):
    rows = source_mix.mix_sources(documents(spark), prior=F.col("weight"), weights=(3, 2, 4), share=1.2).collect()
    priors = {r.doc_id: r.weight for r in documents(spark).collect()}
    for source in ("s0", "s1", "s2"):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.rate * r.size for r in own) - own[0].target) < 1e-4 * own[0].target
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target + 90
        mean = sum(r.size for r in own) / len(own)
        # The log odds of a rate against the cap less those of its prior are a + b * size / mean.
        odds = [(r.size / mean, math.log(r.rate / (2 - r.rate)) - math.log(priors[r.doc_id] / (2 - priors[r.doc_id]))) for r in own]
        (x0, y0), (x1, y1) = min(odds), max(odds)
        assert all(abs(y - (y0 + (y1 - y0) * (x - x0) / (x1 - x0))) < 1e-4 for x, y in odds)
        assert len({round(r.rate, 4) for r in own}) > 20


def test_targets_out_of_reach_raise(spark):
    with pytest.raises(RuntimeError, match="misses its target"):
        source_mix.mix_sources(documents(spark), prior=F.when(F.col("doc_id") < 500, 0.0).otherwise(1.0), share=1.9, steps=6)

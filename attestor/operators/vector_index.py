"""Exact nearest vectors by cosine from inverted lists: lists that cannot hold a better hit are not opened.

Centres come from a bounded sample, every vector goes to the list of its nearest centre, and each list knows how far (as an
angle) its vectors lie from the centre at most. Angles obey the triangle inequality, so a query's angle to a centre less the
list's reach bounds what any vector of the list can score. A query first opens the lists with the best bounds until they
hold k vectors; its k-th score then decides which others can matter, and only those are opened. Nothing is approximate.

What a task gets is bounded: a part of a list and a block of queries. It keeps the best k of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import once

#: Vectors of a part and queries of a block that meet in one task.
PART, BLOCK = 4096, 512
#: Bytes of the sample that centres are fitted on, and the most rows and centres.
SAMPLE_BYTES, SAMPLE, LISTS = 32 << 20, 4096, 256


def units(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def scores(cosines: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.round((1 + cosines) / 2, 4))


def fitted(sample: np.ndarray, lists: int, rounds: int = 5) -> np.ndarray:
    """Unit centres: farthest first, then moved to the means of what is nearest to them."""
    order, far = [0], 1 - sample @ sample[0]
    while len(order) < min(lists, len(sample)) and far.max() > 1e-9:
        order.append(int(far.argmax()))
        far = np.minimum(far, 1 - sample @ sample[order[-1]])
    centres = sample[order]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def sound(column: str) -> object:
    """Whether a vector has a direction: not null, empty or zero, and without null or non-finite components."""
    v = F.col(column)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


class VectorIndex:
    """Inverted lists over vectors (vec_id, embedding). Vectors without a direction, or of another dimension than the sample's first, are in no list."""

    def __init__(self, vectors: DataFrame, lists: int = LISTS):
        rows = vectors.where(F.col("vec_id").isNotNull() & sound("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        # The order of a hash makes the sample the same in every run, however the table is split.
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toLocalIterator()
        held: list = []
        for r in sample:
            if held and (len(held) + 1) * 8 * len(held[0]) > SAMPLE_BYTES:
                break
            if not held or len(r.v) == len(held[0]):
                held.append(r.v)
        self.size = len(held[0]) if held else 0
        self.centres = fitted(units(pd.Series(held)), max(1, min(lists, len(held) // 64))) if held else np.zeros((0, 0))
        centres = self.centres
        kind = vectors.schema["vec_id"].dataType.simpleString()
        self.id_type = kind

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    far = angles(units(rows.v), centres)
                    near = far.argmin(1)
                    yield pd.DataFrame({"vec_id": rows.vec_id, "v": rows.v, "list": near.astype(np.int32), "far": far[np.arange(len(near)), near]})

        self.placed = once(rows.where(F.size("v") == self.size).mapInPandas(placed, f"vec_id {kind}, v array<double>, list int, far double"))

    @cached_property
    def facts(self) -> pd.DataFrame:
        """list, n and reach of each list that holds vectors: at most LISTS rows."""
        return self.placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("reach")).toPandas().sort_values("list", ignore_index=True)

    def _bounds(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, q, opened: lists to open first, others: array of (list, most)) of queries (query_id, query). most: the best score a list can hold."""
        facts, centres = self.facts, self.centres

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if not len(rows):
                    continue
                low = np.maximum(angles(units(rows.q), centres[facts.list]) - facts.reach.to_numpy() - 1e-7, 0.0)
                most = scores(np.cos(low) + 1e-9)
                order = np.argsort(low, axis=1, kind="stable")
                opened, others = [], []
                for i, line in enumerate(order):
                    enough = int(np.searchsorted(np.cumsum(facts.n.to_numpy()[line]), k)) + 1
                    opened.append(facts.list.to_numpy()[line[:enough]])
                    others.append([{"list": int(facts.list[j]), "most": float(most[i, j])} for j in line[enough:]])
                yield pd.DataFrame({"query_id": rows.query_id, "q": rows.q, "opened": opened, "others": others})

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.where(sound("query") & (F.size("query") == self.size)).select("query_id", F.col("query").cast("array<double>").alias("q"))
        return asked.mapInPandas(run, f"query_id {kind}, q array<double>, opened array<int>, others array<struct<list:int,most:double>>")

    def _hits(self, pairs: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the best k of each part of the lists that queries are paired with. pairs: query_id, q, list."""
        spark = pairs.sparkSession
        # One row for each list: into how many parts its vectors fall, and its queries into how many blocks.
        asked = pairs.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        parts = spark.createDataFrame(self.facts.assign(parts=-(-self.facts.n // PART))[["list", "parts"]], "list int, parts int").join(asked, "list")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
        vectors = self.placed.join(F.broadcast(parts), "list").select("list", deal("vec_id", "parts").alias("part"), each("blocks").alias("block"), "vec_id", "v")
        queries = pairs.join(F.broadcast(parts), "list").select("list", each("parts").alias("part"), deal("query_id", "blocks").alias("block"), "query_id", "q")

        def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(q):
                return pd.DataFrame({"query_id": q.query_id[:0], "vec_id": x.vec_id[:0], "score": np.zeros(0)})
            x = x.sort_values("vec_id", ignore_index=True)
            found = scores(units(q.q) @ units(x.v).T)
            best = np.argsort(-found, axis=1, kind="stable")[:, :k]
            return pd.DataFrame({"query_id": np.repeat(q.query_id.to_numpy(), best.shape[1]), "vec_id": x.vec_id.to_numpy()[best.ravel()], "score": np.take_along_axis(found, best, 1).ravel()})

        key = ["list", "part", "block"]
        kind = pairs.schema["query_id"].dataType.simpleString()
        return vectors.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(run, f"query_id {kind}, vec_id {self.id_type}, score double")

    @staticmethod
    def _best(hits: DataFrame, k: int) -> DataFrame:
        by = [F.col("score").desc(), F.col("vec_id")]
        # Ranked within shares first, so no task sees all hits of a query.
        share = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(*by)
        some = hits.withColumn("place", F.row_number().over(share)).where(F.col("place") <= k)
        return some.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("place") <= k)

    def opened(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(first, hits, later): pairs (query_id, q, list) that are opened first, their hits, and the pairs that may still hold a better one."""
        asked = once(self._bounds(queries, k))
        first = asked.select("query_id", "q", F.explode("opened").alias("list"))
        hits = once(self._best(self._hits(first, k), k))
        last = hits.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("held"))
        others = asked.select("query_id", "q", F.explode("others").alias("o")).join(last, "query_id", "left")
        later = others.where((F.coalesce("held", F.lit(0)) < k) | (F.col("o.most") >= F.col("least")))
        return first, hits, later.select("query_id", "q", F.col("o.list").alias("list"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k vectors nearest to each query (query_id, query): query_id, vec_id, score = (1 + cosine) / 2 to four places, place; equal scores by vec_id.

        Queries without a direction or of another dimension find nothing; query ids are unique.
        """
        if not self.size:
            return queries.select("query_id").limit(0).select("query_id", F.lit(None).cast(self.id_type).alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("place"))
        _, hits, later = self.opened(queries, k)
        return self._best(hits.drop("place").unionByName(self._hits(once(later), k)), k)

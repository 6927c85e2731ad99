"""Benchmark items found again in training documents, whole, edited or paraphrased.

Words are runs of letters and digits, lower-cased, so marks and case do not matter. The n-word grams of the items are
seeds, all of them, however many documents hold them: what is found in a document does not depend on the others. Where
seeds of an item lie on nearby diagonals of a document, a Smith-Waterman alignment of the item with that stretch of words scores the copy.

Items come in blocks of a bounded number of words; each block is sent to the tasks and meets all documents there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .shared import Workspace, steady

U = np.uint64
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
MATCH, MISS, GAP = 2, -1, -1
BITS = 24


class Items:
    """A block of items: their words, and their seeds in order of hash."""

    def __init__(self, rows: list[tuple], n: int, shortest: int):
        self.ids, self.words = [], []
        seeds, item, place = [], [], []
        for _, _, data, offsets in T.slices(pa.array([r[1] for r in rows], pa.string())):
            word, begin = words_of(data, offsets)
            for i in range(len(begin) - 1):
                w = word[begin[i] : begin[i + 1]]
                source = rows[len(self.ids)][0]
                self.ids.append(source)
                self.words.append(w)
                if len(w) >= shortest:
                    s = T.shingles(w, np.array([0, len(w)]), n, False)[0]
                    seeds.append(s)
                    item.append(np.full(len(s), len(self.ids) - 1))
                    place.append(np.arange(len(s)))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        seeds, item, place = join(seeds, U), join(item, np.int64), join(place, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.item, self.place = item[order], place[order]
        self.seeds, self.first, self.count = np.unique(seeds[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << (BITS - 3), np.uint8)
        low = (self.seeds & U((1 << BITS) - 1)).astype(np.int64)
        np.bitwise_or.at(self.table, low >> 3, (1 << (low & 7)).astype(np.uint8))
        self.length = np.array([len(w) for w in self.words], np.int64)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in grams that hold a seed, and which."""
        low = grams & U((1 << BITS) - 1)
        at = np.flatnonzero(self.table[(low >> U(3)).astype(np.int64)] >> (low & U(7)).astype(np.uint8) & 1)
        if not len(at):
            return at, at
        seed = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        same = self.seeds[seed] == grams[at]
        return at[same], seed[same]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = T.LOWER[data]
    starts, ends = T.cut(data, offsets, APART)
    return T.hashes(data, starts, ends), np.searchsorted(starts, offsets)


def align(items: list[np.ndarray], stretches: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences, all pairs at once, one item word at a time."""
    height, width = max(map(len, items)), max(map(len, stretches))
    a = np.zeros((len(items), height), U)
    b = np.full((len(items), width), 1, U)
    for k, (x, y) in enumerate(zip(items, stretches, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    inside = np.arange(width)[None] < np.array([len(y) for y in stretches])[:, None]
    ramp = -GAP * np.arange(width + 1, dtype=np.int32)
    h, best = np.zeros((len(items), width + 1), np.int32), np.zeros(len(items), np.int32)
    lens = np.array([len(x) for x in items])
    for i in range(height):
        same = (b == a[:, i : i + 1]) & inside
        c = np.zeros_like(h)
        c[:, 1:] = np.maximum(0, np.maximum(h[:, :-1] + np.where(same, MATCH, MISS), h[:, 1:] + GAP))
        c = np.maximum.accumulate(c + ramp, 1) - ramp
        h = np.where((i < lens)[:, None], c, h)
        best = np.maximum(best, h.max(1))
    return best


def stretches(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, length: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, last word) where seeds of an item lie on nearby diagonals."""
    diagonal = at - place
    order = np.lexsort((diagonal, item, doc))
    doc, item, place, diagonal = doc[order], item[order], place[order], diagonal[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > np.maximum(6, length[item[1:]] // 4))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    distinct = np.bincount(np.unique(np.stack([group, place], 1), axis=0)[:, 0], minlength=len(first))
    for k in np.flatnonzero(distinct >= least):
        i, j = first[k], last[k]
        size = int(length[item[i]])
        pad = size // 4 + 4
        yield int(doc[i]), int(item[i]), int(diagonal[i]) - pad, int(diagonal[j]) + size + pad


def leaks_in(items: Items, column: pa.Array, n: int, least: int, cut: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for top, _, data, offsets in T.slices(column):
        word, begin = words_of(data, offsets)
        gram, where = T.shingles(word, begin, n, False)
        at, seed = items.hits(gram)
        if not len(at):
            continue
        doc = np.searchsorted(where, at, "right") - 1
        many = items.count[seed]
        take = np.repeat(items.first[seed] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        found = list(stretches(np.repeat(doc, many), items.item[take], np.repeat(at - where[doc], many), items.place[take], items.length, least))
        found = [(d, i, word[max(begin[d], begin[d] + s) : max(begin[d], min(begin[d + 1], begin[d] + e))]) for d, i, s, e in found]
        found.sort(key=lambda f: (len(items.words[f[1]]), len(f[2])))
        best: dict[tuple[int, int], float] = {}
        k = 0
        while k < len(found):
            size = max(1, min(256, 2_000_000 // max(1, len(found[min(k + 255, len(found) - 1)][2]))))
            part = found[k : k + size]
            for (d, i, _), s in zip(part, align([items.words[i] for _, i, _ in part], [w for _, _, w in part]).tolist(), strict=True):
                best[d, i] = max(best.get((d, i), 0.0), s / (MATCH * len(items.words[i])))
            k += size
        for (d, i), score in sorted(best.items()):
            if score >= cut:
                out[top + d].append({"item_id": items.ids[i], "score": score})
    return out


def _found(items: Items, n: int, least: int, cut: float):
    def run(batches):
        for batch in batches:
            new = leaks_in(items, batch.column(0).field("text").cast(pa.string()), n, least, cut)
            old = batch.column(1).to_pylist()
            leaks = pa.array([a + b for a, b in zip(old, new, strict=True)], pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), leaks], ["row", "leaks"])

    return run


def find_leaks(
    docs: DataFrame, items: DataFrame, n: int = 3, cut: float = 0.55, least: int = 2, shortest: int = 5, block_words: int = 1_000_000
) -> DataFrame:
    """Adds leaks, an array of (item_id, score) of the items that a document's text holds, to docs.

    docs: any columns with text; items: item_id, text. score is the best local alignment of the item's words in the text
    (2 for equal words, -1 for others and for gaps) against that of the item with itself; an item is held from `cut` on. At
    least `least` different seeds of n words must lie near one diagonal. Items of fewer than `shortest` words, or with a
    null text, are not sought; a null or empty text holds none. Equal items are each reported. A column leaks of docs is
    replaced. Items are taken in blocks of at most block_words words (or one longer item); each block costs one pass over the texts and
    no shuffle of them.
    """
    spark = docs.sparkSession
    steady(spark)
    docs = docs.drop("leaks")
    none = F.array().cast("array<struct<item_id:bigint,score:double>>")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    out = docs.select(row.alias("row"), none.alias("leaks"))
    work = Workspace(spark, "leaks")
    block: list[tuple] = []
    size = blocks = 0

    def add(out: DataFrame) -> DataFrame:
        made = Items(block, n, shortest)
        if not len(made.seeds):
            return out
        return out.select("row", "leaks").mapInArrow(_found(made, n, least, cut), f"row {kind}, leaks array<struct<item_id:bigint,score:double>>")

    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = len(r[1]) // 2 + 1
        if block and size + words > block_words:
            out, block, size, blocks = work.keep(add(out), f"block{blocks}"), [], 0, blocks + 1
            if blocks > 1:
                work.drop(f"block{blocks - 2}")
        block.append((r[0], r[1]))
        size += words
    if block:
        out = add(out)
    return out.select("row.*", "leaks")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold an item."""
    return find_leaks(docs, items, **options).where(F.size("leaks") == 0).drop("leaks")

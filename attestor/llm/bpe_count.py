"""Token counts by byte-pair merging with a heap and a linked list.

Text is cut into pieces by the vocabulary's pattern; within a piece the adjacent pair of the lowest rank is popped
from a heap, its symbols are joined in a doubly linked list and the two new pairs are pushed, until no pair has a rank.
A piece has as many tokens as it has bytes less merges. No token id is looked up or emitted. Special strings count as
one token each, as the tokenizers library takes them by default.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import steady

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: So many pieces, up to such a length, are remembered by a worker; past that it starts anew, which changes no count.
REMEMBERED, SHORT = 1 << 20, 48


def byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes, as a table from letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {256 + k: b for k, b in enumerate(other)}


class Counter(dict):
    """From a piece to its number of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        table = byte_letters()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in found["model"]["merges"])
        self.ranks = {(a.translate(table), b.translate(table)): k for k, (a, b) in enumerate(pairs)}
        self.special = sorted((x["content"] for x in found["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PIECES)

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def merged(self, piece: str) -> int:
        symbols = list(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
        n = len(symbols)
        if n < 2:
            return n
        rank = self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or rank((symbols[i], symbols[j])) != r:
                continue  # one of the two has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
            merges += 1
        return n - merges

    def count(self, text: str) -> int:
        if self.split is None:
            return sum(map(self.__getitem__, self.pieces.findall(text)))
        total = 0
        for k, part in enumerate(self.split.split(text)):
            total += (k > 0) + sum(map(self.__getitem__, self.pieces.findall(part)))
        return total


_counters: dict[str, Counter] = {}


def _count(path: str):
    def run(batches):
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            n = [counter.count(t) if t else 0 for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """Returns a row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary is the path of a byte-level BPE file of the tokenizers library, readable on every executor. A null text
    counts as empty: no bytes, no tokens. Ids may be null or repeat; each row keeps its own counts. Other columns are
    ignored. A very long text, or one without any break, is merged whole in n log n steps. No row is shuffled.
    """
    steady(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

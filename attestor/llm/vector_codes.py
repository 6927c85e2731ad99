"""Vectors compressed to one byte a part: product codes in whole numbers, nearest entries found by a VA-file.

Every part of a vector is a query against the entries of its codebook. Each coordinate of an entry is quantised to a few
bits, the number of the cell that it lies in. A query's look-up tables hold, for each coordinate and cell, the least and the
greatest squared distance to any point of that cell; their sums over an entry's cells bound its distance. Only entries
whose lower bound is not above the least upper bound are refined with whole-number distances, so the result is exact.

Codebooks have a fixed size, so they travel with the tasks. Each round every task adds up the parts that fall to each
entry, and a group-by of at most entries x parts rows a task gives the new codebooks; no vector is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, with_totals

#: Components beyond this (|x| > 16,384 before scaling) count as this, so that distances of up to 4,096 components fit 64 bits.
LIMIT = 1 << 24


class Cells:
    """The VA-file of one codebook: entries (k, d) as numbers of cells."""

    def __init__(self, entries: np.ndarray, bits: int = 4):
        self.entries = entries
        self.low = entries.min(0)
        self.width = ((entries.max(0) - self.low) >> bits) + 1
        cell = (entries - self.low) // self.width
        (k, d), cells = entries.shape, 1 << bits
        #: Cell numbers as rows of ones, so that sums of looked-up bounds are one product of matrices.
        self.marked = np.zeros((d * cells, k))
        self.marked[(np.arange(d) * cells + cell).ravel(), np.repeat(np.arange(k), d)] = 1
        self.floor = self.low[:, None] + np.arange(cells) * self.width[:, None]
        self.ceiling = self.floor + self.width[:, None] - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of queries x (q, d) to all entries."""
        below, above = self.floor - x[:, :, None], x[:, :, None] - self.ceiling
        near = np.maximum(np.maximum(below, above), 0).astype(np.float64)
        far = np.maximum(np.abs(below), np.abs(above)).astype(np.float64)
        return (near * near).reshape(len(x), -1) @ self.marked, (far * far).reshape(len(x), -1) @ self.marked

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest entry, the first of equals, and its squared distance."""
        low, high = self.bounds(x)
        # A hair of slack outweighs the rounding of sums above 2**53.
        q, e = np.nonzero(low * (1 - 1e-12) <= high.min(1)[:, None] * (1 + 1e-12))
        gap = x[q] - self.entries[e]
        exact = np.full(low.shape, np.iinfo(np.int64).max)
        exact[q, e] = np.einsum("ij,ij->i", gap, gap)
        best = exact.argmin(1)
        return best, exact[np.arange(len(x)), best]


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    spare = -flat.shape[1] % parts
    return np.pad(flat, ((0, 0), (0, spare))).reshape(len(flat), parts, -1)


def _sums(books: np.ndarray):
    """For each task and entry of the codebooks (parts, k, d) how many parts are nearest to it, and their sums."""

    def run(batches):
        cells = [Cells(b) for b in books]
        count, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0), len(books))
                for p, c in enumerate(cells):
                    best, _ = c.nearest(x[:, p])
                    count[p] += np.bincount(best, minlength=len(c.entries))
                    np.add.at(sums[p], best, x[:, p])
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray):
    def run(batches):
        cells = [Cells(b) for b in books]
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(2), len(books))
            found = [c.nearest(x[:, p]) for p, c in enumerate(cells)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(f[1] for f in found))], names=["id", "key", "code", "error"])

    return run


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (parts, entries, components) they refer to.

    The codes have a row for each kept vector: vec_id, code (two hex digits a part), error (squared distance, in whole
    numbers of 1/scale), label_error (error summed over equal labels, nulls together). Codebooks start as the parts of
    the vectors with the smallest ids (ties by content); with fewer vectors they have fewer entries. Each round replaces
    an entry by the floor of the mean of its parts; unused entries stay.

    Left out are vectors that are null or empty or hold a null or non-finite component, rows without an id, and vectors
    of another dimension than that of the smallest id. Rows that repeat an id count each. A dimension that parts do not
    divide is filled up with zeros. An empty table gives no rows and no codebooks. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    work = Workspace(vectors.sparkSession, "vector-codes")
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(label_column).cast("string")), F.lit("")).alias("key"), v.alias("v"))
    rows = rows.where("id is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    rows = work.keep(rows.select("id", "key", whole.alias("v")), "whole")
    least = rows.orderBy("id", "v").limit(1).collect()
    size = len(least[0].v) if least else 0
    rows = rows.where(F.size("v") == size)
    # As many vectors as a codebook has entries, never more.
    start = [r.v for r in rows.orderBy("id", "v").limit(entries).select("v").collect()]
    columns = -(-size // parts)
    books = _matrix(pa.array(start, pa.list_(pa.int32())), parts).transpose(1, 0, 2).copy() if start else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if start else 0):
        sums = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(columns))).alias("sums"))
        for r in sums.toLocalIterator():  # at most parts x entries rows
            books[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    if not start:
        coded = rows.select("id", "key", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = work.keep(rows.select("id", "key", "v").mapInArrow(_coded(books), "id long, key string, code string, error long"), "codes")
    out = with_totals(coded, ["key"], "id", label_error=("error", F.sum))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

"""Fill-in-middle: whole texts cut at two token boundaries and put together again with sentinels.

A token is `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, so tokens end after a word's last character and at
the end of a text: whether one ends at a character depends on it and its right neighbour alone. The texts of an Arrow batch
lie behind each other in memory and are cut into chunks that overlap by that neighbour. All chunks count their boundaries,
prefix sums over a text's chunks say which chunk owns a cut's rank, and only owning chunks are scanned again for its place.
White space is ASCII, so bytes serve as characters. Nothing is shuffled: rows keep their place and texts never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import steady
from .textops import SPACE, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and of the chunks that are looked at together.
CHUNK, BLOCK = 4096, 1 << 20
OUT = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


def ends(data: np.ndarray, first: int, past: int, last: np.ndarray) -> np.ndarray:
    """Whether a token ends with each of the bytes first to past, looking one byte further. last: sorted places of texts' last bytes."""
    space = SPACE[data[first : past + 1]]
    here = ~space[: past - first]
    here[: len(space) - 1] &= space[1 : past - first + 1]
    here[last[np.searchsorted(last, first) : np.searchsorted(last, past)] - first] = True
    return here


class Chunks:
    """Token boundaries of the texts data[offsets[t]:offsets[t + 1]], counted chunk by chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = CHUNK):
        many = -(-np.diff(offsets) // size)
        self.data, self.last = data, offsets[1:][many > 0] - 1
        self.begin = np.concatenate([[0], np.cumsum(many)])
        place = np.arange(self.begin[-1]) - np.repeat(self.begin[:-1], many)
        self.first = np.repeat(offsets[:-1], many) + place * size
        self.past = np.minimum(self.first + size, np.repeat(offsets[1:], many))
        counts = np.zeros(len(self.first), np.int64)
        at = 0
        while at < len(counts):
            to = max(at + 1, int(np.searchsorted(self.past, self.first[at] + BLOCK, "right")))
            counts[at:to] = np.add.reduceat(ends(data, self.first[at], self.past[to - 1], self.last).astype(np.int64), self.first[at:to] - self.first[at])
            at = to
        self.sums = np.concatenate([[0], np.cumsum(counts)])
        #: Tokens of each text.
        self.n = self.sums[self.begin[1:]] - self.sums[self.begin[:-1]]

    def place(self, text: int, rank: int) -> int:
        """Where the text's token number rank ends (its start for rank 0), in bytes from the batch's start."""
        if rank == 0:
            return int(self.first[self.begin[text]])
        whole = self.sums[self.begin[text]] + rank
        owner = int(np.searchsorted(self.sums, whole, "left")) - 1
        found = np.flatnonzero(ends(self.data, self.first[owner], self.past[owner], self.last))
        return int(self.first[owner] + found[whole - self.sums[owner] - 1]) + 1


def _transformed(rate: int, spm: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def chars(piece: bytes) -> int:
        return int(np.count_nonzero((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80))

    def run(batches):
        for batch in batches:
            draws = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]) if len(batch) else None
            for top, to, data, offsets in slices(batch.column(1), BLOCK):
                cut = Chunks(data, offsets)
                form, fore, mid, out = [], [], [], []
                for t in range(to - top):
                    text = data[offsets[t] : offsets[t + 1]].tobytes()
                    h1, h2, h3, h4 = (int(x) for x in draws[:, top + t])
                    if not text or h3 % 100 >= rate or any(x in text for x in marks):
                        form.append("plain"), fore.append(None), mid.append(None), out.append(text)
                        continue
                    units = int(cut.n[t]) + 1
                    a, b = sorted((h1 % units, h2 % units))
                    i, j = (cut.place(t, r) - int(offsets[t]) for r in (a, b))
                    prefix, middle, suffix = text[:i], text[i:j], text[j:]
                    kind = "spm" if h4 % 100 < spm else "psm"
                    form.append(kind), fore.append(chars(prefix)), mid.append(chars(middle))
                    out.append(b"".join([s, suffix, p, prefix, m, middle] if kind == "spm" else [p, prefix, s, suffix, m, middle]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(top, to - top), pa.array(cut.n, pa.int64()), pa.array(form, pa.string()), pa.array(fore, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Returns a row for each row of docs (doc_id, text): doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    form is plain (output is the text), psm or spm. Numbers drawn from the digest of seed and doc_id decide: rate percent of
    the texts are transformed, spm percent of these into spm; the cuts lie after two drawn numbers of tokens, from none to all,
    so any of the three pieces may be empty. Texts that are empty or hold a sentinel stay plain. A null text counts as
    empty, a null doc_id draws from the empty string; rows that repeat an id draw alike. prefix_chars and middle_chars
    count code points and are null for plain texts. Other columns are ignored. A very long text is one value and so
    belongs to one task, which holds it a few times over.
    """
    steady(docs.sparkSession, 256)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *draws)
    return rows.mapInArrow(_transformed(rate, spm), OUT).withColumnRenamed("id", "doc_id")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle came from. No text holds a sentinel, so each stands where it first occurs."""
    after = lambda x, mark: F.substring(x, F.locate(mark, x) + F.lit(len(mark)), F.length(x))
    until = lambda x, mark: F.substring_index(x, mark, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(until(after(output, PREFIX), SUFFIX), middle, until(after(output, SUFFIX), MIDDLE))
    spm = F.concat(until(after(output, PREFIX), MIDDLE), middle, until(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

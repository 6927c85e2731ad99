"""Words and their hashes over whole Arrow batches, with numpy and without a Python loop over words.

Words are the maximal runs of bytes other than space and 0x09-0x0D; only A-Z are lower-cased. A word's hash is a
64-bit polynomial hash of its bytes, mixed; a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_BACK = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(str(base))
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 17), base, U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[str(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    if not big and not pa.types.is_string(column.type):
        column, big = column.cast(pa.large_string()), True
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, size: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets from 0) of runs of whole texts of about size bytes, or one longer text."""
    data, offsets = texts_of(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def cut(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which breaks[byte] is false, within the texts."""
    solid = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    after[-1:], after[:-1] = False, solid[1:]
    return np.flatnonzero(solid & (~before | first[:-1])), np.flatnonzero(solid & (~after | first[1:])) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data))[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power(_BACK, len(data))[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some texts, and where each text's words begin (n + 1 numbers)."""
    data = LOWER[data]
    starts, ends = cut(data, offsets, SPACE)
    return hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(word: np.ndarray, begin: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, in order, and where each text's begin.

    With short, a text of one to k - 1 words has one shingle of all its words; without, it has none.
    """
    count = np.diff(begin)
    many = np.where(count >= k, count - k + 1, (count > 0) if short else 0)
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(at[-1], U)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(count >= k)
        if len(long):
            total = int(many[long].sum())
            place = np.arange(total) + np.repeat(at[long] - np.concatenate([[0], np.cumsum(many[long])[:-1]]), many[long])
            source = np.arange(total) + np.repeat(begin[long] - np.concatenate([[0], np.cumsum(many[long])[:-1]]), many[long])
            h = np.full(total, k, U)
            for j in range(k):
                h = (h ^ word[source + j]) * U(0x9E3779B97F4A7C15)
                h ^= h >> U(32)
            out[place] = mix(h)
        for c in range(1, k) if short else ():
            few = np.flatnonzero(count == c)
            h = np.full(len(few), c, U)
            for j in range(c):
                h = (h ^ word[begin[few] + j]) * U(0x9E3779B97F4A7C15)
                h ^= h >> U(32)
            out[at[few]] = mix(h)
    return out, at


def nested(values: np.ndarray, begin: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and where each list begins."""
    flat = pa.array(values.view(np.int64) if values.dtype == U else values, kind)
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), flat)

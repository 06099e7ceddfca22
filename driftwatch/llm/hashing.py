"""Numpy helpers of the operators that look at whole blocks of texts inside a task."""
from __future__ import annotations

import numpy as np

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves about half of the output's."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= _ODD
    h ^= h >> U64(32)
    return h


#: A random-looking odd number for each byte, and the multiplier of positions.
BYTES = mix(np.arange(1, 257, dtype=U64) * _ODD) | U64(1)
STEP = 0x5851F42D4C957F2D
CHUNK = 1 << 19


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slice_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices ``data[start:start + length]`` (lengths of 1 and more), chunk by chunk."""
    out = np.empty(len(start), U64)
    if not len(start):
        return out
    weight = powers(int(length.max()))
    ends = np.cumsum(length)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = length[at:to]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        value = BYTES[data[inside + np.repeat(start[at:to], n)]] * weight[inside]
        out[at:to] = mix(np.add.reduceat(value, first) + n.astype(U64) * _ODD)
        at = to
    return out


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices, one behind the other."""
    total = int(length.sum())
    if not total:
        return data[:0]
    first = np.cumsum(length) - length
    return data[np.arange(total, dtype=np.int64) + np.repeat(start - first, length)]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... first[i] + count[i] - 1 for each i in turn."""
    total = int(count.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(first - (np.cumsum(count) - count), count)


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_table(data: np.ndarray, doc_start: np.ndarray, lower: bool = False):
    """Words (runs of non-blank bytes) of texts laid one behind the other.

    Returns the words' bytes with one blank behind each, the offset of each word
    there (and the end), and for each document the number of words before it.
    """
    n_docs = len(doc_start) - 1
    if lower:
        data = _LOWER[data]
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = doc_start[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = solid[inner]  # no word crosses documents
    start = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    ends[before] = solid[before]
    length = np.flatnonzero(ends) + 1 - start
    offset = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length + 1, out=offset[1:])
    out = np.full(int(offset[-1]), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offset[1:] - 1] = False
    out[keep] = data[solid]
    first = np.searchsorted(start, doc_start).astype(np.int64)
    assert len(first) == n_docs + 1
    return out, offset, first

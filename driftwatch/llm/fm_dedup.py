"""Substring dedup over words with compressed FM-indexes.

Spark brings fragments with a shared anchor together (``repeats``); each shard of
fragments gets an FM-index: the Burrows-Wheeler transform of its words (numbered
within the shard) in a wavelet tree of packed bits, so a symbol takes as many bits
as the shard's vocabulary needs. The fragments are then streamed against it:
backward search takes a window's words from last to first, all windows of the
shard at once, and keeps the interval of suffixes that begin with what was read.
A window whose interval has shrunk to one suffix (itself) is dropped early: its
matching statistic is below the threshold. What is left after 13 words matches in
full; the smallest document id in its interval is what it is compared with.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.hashing import U64, slice_hashes, spread
from driftwatch.llm.repeats import BLOCK_BYTES, HOT, Kind, remove_repeats

WINDOW, GRAM = 13, 4
QUERIES = 1 << 15


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit; each
    level is a packed bit vector with counts per 64 bits, zeros dealt before ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.n = len(symbols)
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            packed = np.zeros(-(-(self.n + 1) // 64) * 8, np.uint8)
            raw = np.packbits(one, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view("<u8")
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.levels.append((words, counts, self.n - int(one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` is mapped on the last level along the path of ``symbol``."""
        for level, (words, counts, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            at = place >> 6
            below = (U64(1) << (place & 63).astype(U64)) - U64(1)
            ones = counts[at] + np.bitwise_count(words[at] & below)
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """Index of a text of numbers (0 is the mark behind each fragment) for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.n_symbols = int(text.max(initial=0)) + 1
        rank, known = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while known < depth:  # sorted by the first 1, 2, 4, ... symbols
            follow = np.zeros(n, np.int64)
            follow[:-known] = rank[known:] + 1
            key = rank * (n + 2) + follow
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[order[1:]] != key[order[:-1]]))
            known *= 2
        self.order = order
        self.tree = WaveletTree(text[order - 1], self.n_symbols)
        count = np.bincount(text, minlength=self.n_symbols)
        self.less = np.cumsum(count) - count  # symbols smaller than each
        every = np.arange(self.n_symbols)
        self.shift = self.less - self.tree.descend(every, np.zeros(self.n_symbols, np.int64))
        self.count = count

    def first(self, symbol: np.ndarray):
        return self.less[symbol], self.less[symbol] + self.count[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals after one more symbol in front."""
        both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        move = self.shift[symbol]
        return both[:len(low)] + move, both[len(low):] + move


def smallest_ids(data, start, size, windows, ids) -> np.ndarray:
    """For each window of each fragment the smallest id of a fragment that contains it."""
    text, where, owner = _number(data, start, size)
    index = FMIndex(text, WINDOW)
    doc = ids[owner[index.order]]  # marks belong to the fragment before them
    at = spread(where, windows)
    own = np.repeat(ids, windows)
    out = own.copy()
    for c in range(0, len(at), QUERIES):
        query = np.arange(c, min(c + QUERIES, len(at)))
        place = at[query]
        low, high = index.first(text[place + WINDOW - 1])
        for step in range(WINDOW - 2, -1, -1):
            several = high - low > 1
            query, place = query[several], place[several]
            low, high = index.extend(text[place + step], low[several], high[several])
        several = high - low > 1
        query, low, high = query[several], low[several], high[several]
        if not len(query):
            continue
        # equal windows have equal intervals, and different ones don't overlap
        left, which = np.unique(low, return_inverse=True)
        right = np.empty(len(left), np.int64)
        right[which] = high
        ends = np.empty(2 * len(left), np.int64)
        ends[0::2], ends[1::2] = left, right
        least = np.minimum.reduceat(np.append(doc, doc[-1:]), ends)[::2]
        out[query] = least[which]
    return out


def _number(data, start, size):
    """Words of all fragments as numbers from 1, with a 0 behind each fragment; the
    place of each fragment's first word; the fragment of each place."""
    whole = data[spread(start, size)]
    blank = np.flatnonzero(whole == 32)  # one blank stands behind each word
    begin = np.append(0, blank[:-1] + 1)
    hashes = slice_hashes(whole, begin, np.maximum(blank - begin, 1))
    _, number = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(size)
    n_words = np.diff(np.searchsorted(blank, np.append(0, ends)))
    where = np.cumsum(n_words + 1) - (n_words + 1)
    text = np.zeros(len(number) + len(start), np.int64)
    text[spread(where, n_words)] = number + 1
    return text, where, np.repeat(np.arange(len(start)), n_words + 1)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Rows ``(doc_id, h, n_words, n_removed, spans, kept)``, one per row of ``docs``
    (``h`` is Spark's ``xxhash64`` of the text): the words of
    the text (runs of non-blank characters) without those covered by 13 words in a row that
    also start in a document with a smaller id; ``spans`` are the maximal removed runs (in
    words), ``kept`` the other words' UTF-8 bytes, joined by one space.

    Words are compared by 64-bit hashes. A null text has no words; texts under 13 words stay
    whole; a null id stands behind all other ids; rows with equal ids don't remove each other's
    words; an empty table gives no rows; other columns are not looked at.
    """
    kind = Kind(words=True, window=WINDOW, gram=GRAM)
    out = remove_repeats(docs, kind, smallest_ids, id_col, text_col, block_bytes, hot)
    return out.select(F.col("doc_id").alias(id_col), "h", F.col("n_units").alias("n_words"), "n_removed", "spans", "kept")

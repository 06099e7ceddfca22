"""Suffix-array dedup of byte passages, built column by column over many strings.

Spark brings fragments with a shared anchor together (``repeats``). Over each
bucket of fragments this module builds the suffix order of the whole collection
the way it is done for large collections of strings on disk: round j inserts the
suffix of length j of every string, one symbol per string, into the collection's
Burrows-Wheeler transform and its array of common prefixes. Where a suffix goes
follows from the transform alone (LF mapping); how much it has in common with the
one before follows from the least common prefix between the two places it came
from. Each round reads transform, prefixes and owners front to back and writes
them anew; arrays above ``IN_MEMORY`` lie in external files in between, which are
scratch of one task attempt and are deleted with it.

Suffixes that agree in a whole window stand side by side at the end, and the
smallest document id among them is what the window is compared with.
"""
from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.repeats import BLOCK_BYTES, HOT, Kind, remove_repeats

WINDOW, GRAM = 50, 20
#: Arrays above this size lie in external files between the rounds.
IN_MEMORY = 32 << 20


class _Store:
    """An array that each round replaces whole: in memory, or in an external file if it is large."""

    def __init__(self, folder: str, name: str):
        self.path, self.held = os.path.join(folder, name), None

    def write(self, a: np.ndarray) -> None:
        self.held = a
        if a.nbytes > IN_MEMORY:
            self.held = a.dtype
            a.tofile(self.path)

    def read(self) -> np.ndarray:
        return self.held if isinstance(self.held, np.ndarray) else np.fromfile(self.path, self.held)


def _prefixes(common: np.ndarray, order: np.ndarray, symbol: np.ndarray, rank: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffix at each rank of the new order with the one before it:
    one symbol more than the least common prefix between their places in the old order."""
    out = np.zeros(len(rank), common.dtype)
    same = rank > 0
    same[same] = symbol[rank[same]] == symbol[rank[same] - 1]
    at = np.flatnonzero(same)
    if len(at):
        r = rank[at]
        fall = slice(None, None, -1)  # falling starts: little between the ranges is looked at
        r = r[fall]
        ends = np.empty(2 * len(r), np.int64)
        ends[0::2], ends[1::2] = order[r - 1] + 1, order[r] + 1
        least = np.minimum.reduceat(np.append(common, common.dtype.type(0)), ends)[::2]
        out[at[fall]] = np.minimum(least.astype(np.int64) + 1, cap)
    return out


def collection_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, cap: int):
    """Suffixes of all strings in sorted order, as (string, length, common prefix with the one
    before, at most ``cap``). Each string ends with a mark of its own, which orders by the string."""
    m = len(start)
    with tempfile.TemporaryDirectory() as folder:
        # symbol before the suffix (UTF-8 has no byte 255; 0 is the end mark) and common prefix; string and length
        transform, owners = _Store(folder, "transform"), _Store(folder, "owners")
        transform.write((data[start + size - 1].astype(np.uint16) + 1) << 8)
        owners.write(np.arange(m, dtype=np.int64 if m >> 23 else np.int32) << 8)
        fresh = np.ones(m, bool)  # places filled in the last round
        for j in range(1, int(size.max(initial=0)) + 1):
            have, strings = transform.read(), owners.read()
            symbols, common = (have >> 8).astype(np.uint8), have.astype(np.uint8)
            order = np.argsort(symbols, kind="stable")
            order = order[len(symbols) - np.count_nonzero(symbols):]  # whole strings (end mark before them) stop here
            extended, added = symbols[order], fresh[order]
            rank = np.flatnonzero(added)
            added[1:] |= added[:-1].copy()
            touched = np.flatnonzero(added)  # new suffixes, and those that follow one
            who = strings[order[rank]] >> 8
            left = size[who] - j
            symbol = np.where(left > 0, data[start[who] + np.maximum(left, 1) - 1].astype(np.uint16) + 1, 0)
            place = m + rank  # the m empty suffixes stand first
            fresh = np.zeros(len(symbols) + len(rank), bool)
            fresh[place] = True
            # old entries keep their order and move up by the new ones before them
            source = np.arange(len(fresh), dtype=np.int32 if len(fresh) < 1 << 31 else np.int64)
            source -= np.cumsum(fresh, dtype=source.dtype)
            out = have.take(source, mode="clip")
            out[place] = symbol << 8
            place_touched = m + touched
            out[place_touched] = (out[place_touched] & 0xFF00) | _prefixes(common, order, extended, touched, cap)
            transform.write(out)
            out = strings.take(source, mode="clip")
            out[place] = (who << 8) | j
            owners.write(out)
        strings = owners.read()
        return (strings >> 8).astype(np.int64), (strings & 255).astype(np.int64), transform.read() & 0xFF


def smallest_ids(data, start, size, windows, ids) -> np.ndarray:
    """For each window of each string the smallest id of a string that contains it."""
    string, length, common = collection_order(data, start, size, WINDOW)
    long = length >= WINDOW
    groups = np.cumsum(common < WINDOW)
    string, length, groups = string[long], length[long], groups[long]
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    least = np.minimum.reduceat(ids[string], first)
    number = np.cumsum(np.append(0, groups[1:] != groups[:-1]))
    out = np.empty(int(windows.sum()), np.int64)
    before = np.cumsum(windows) - windows
    out[before[string] + size[string] - length] = least[number]
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, spans, kept)``, one per row of ``docs``: the UTF-8
    bytes of the text without those covered by 50 bytes that also start in a document with
    a smaller id; ``spans`` are the maximal removed runs, ``kept`` the other bytes.

    A null text is an empty one; texts under 50 bytes stay whole; a null id stands behind
    all other ids; rows with equal ids don't remove each other's bytes; an empty table
    gives no rows; other columns are not looked at.
    """
    kind = Kind(words=False, window=WINDOW, gram=GRAM)
    out = remove_repeats(docs, kind, smallest_ids, id_col, text_col, block_bytes, hot)
    return out.select(F.col("doc_id").alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "spans", "kept")

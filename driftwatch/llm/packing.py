"""Packing documents into token sequences by the sum-of-squares rule.

A bin is a sequence of ``capacity`` tokens; N(g) counts the open bins with a
residual gap of g. Each document goes where the sum of N(g)^2 over all gaps
(0 < g < capacity) becomes smallest: into a bin of some gap, or a new bin.
This keeps the gaps varied, so later documents find one that they fill.

A document longer than a sequence is cut into full pieces; only its first piece
may be shorter. Full pieces are sequences of their own and stay where they are.
The others are dealt by hash to groups of some ``GROUP_ITEMS`` pieces (group
count follows the data, so one task never holds more); a group is packed in
descending order of length, then the bins that did not fill up are dissolved and
packed again by the same rule as long as that saves a bin.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.tokens import encoder
from driftwatch.session import cut_lineage

GROUP_ITEMS = 50_000
ROWS_OUT = 8192


def sum_of_squares(items: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Bins of (key, size) items, 0 < size <= capacity, placed in the given order.

    Ties go to the smallest gap, and to an open bin rather than a new one.
    """
    count = np.zeros(capacity + 1, np.int64)  # N(g); N(0) and N(capacity) stay 0
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[tuple[int, int]]] = []
    never = np.int64(1 << 60)
    for key, size in items:
        new = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        gap = 0
        if size < capacity:
            here = count[size:capacity]
            change = np.where(here > 0, 2 * (count[:capacity - size] - here) + 2, never)
            if here[0] > 0:
                change[0] = 1 - 2 * here[0]  # the bin is full and no longer counts
            best = int(change.argmin())
            if change[best] <= new:
                gap = best + size
        if gap:
            place = at_gap[gap].pop()
            count[gap] -= 1
            bins[place].append((key, size))
        else:
            gap, place = capacity, len(bins)
            bins.append([(key, size)])
        if gap > size:
            at_gap[gap - size].append(place)
            count[gap - size] += 1
    return bins


def pack_group(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int]]]:
    order = np.argsort(-sizes, kind="stable")
    bins = sum_of_squares([(int(i), int(sizes[i])) for i in order], capacity)
    while True:
        gaps = [capacity - sum(s for _, s in b) for b in bins]
        rest = [b for b, g in zip(bins, gaps) if g]
        again = sum_of_squares(sorted((x for b in rest for x in b), key=lambda x: (-x[1], x[0])), capacity)
        if len(again) >= len(rest):
            return bins
        bins = [b for b, g in zip(bins, gaps) if not g] + again


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str,
           blanks: str, lower: bool, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, h, ids) of each piece; ids are null unless asked for."""
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "h", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(vocabulary, blanks, lower), []
        for batch in batches:
            for doc_id, text, h in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids = enc.ids(text.as_py()) + end
                n, begin, piece, key, mix = len(ids) // 4, 0, 0, doc_id.as_py(), h.as_py()
                stop = n % capacity or capacity
                while begin < n:
                    part = ids[4 * begin:4 * stop]
                    out.append((key, piece, begin, stop - begin, zlib.crc32(part), mix, part if with_ids else None))
                    begin, stop, piece = stop, stop + capacity, piece + 1
                if len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, h long, ids binary")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id",
         text_col: str = "text", blanks: str = "lead", lower: bool = False, with_ids: bool = False,
         group_items: int = GROUP_ITEMS) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``, one per piece.

    A null or empty text is the end id alone; null ids and repeated rows are
    documents like others; an empty table gives no rows. Sequence ids are any
    numbers: from 0 up for full pieces, negative for packed sequences.
    """
    cut = cut_lineage(pieces(docs, vocabulary, end_id, capacity, id_col, text_col, blanks, lower, with_ids))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    full = cut.where(F.col("length") == capacity).select(
        *keep, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.where(F.col("length") < capacity).select(*keep, "h")
    groups = -(-short.count() // group_items) or 1
    short = short.withColumn("g", F.pmod(F.xxhash64("h", "piece", F.lit(5)), F.lit(groups)))

    def place(key, table):
        table = table.sort_by([("h", "ascending"), ("length", "descending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_numpy()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = key[0].as_py() << 32
        for number, members in enumerate(pack_group(sizes, capacity)):
            at = 0
            for i, size in members:
                seq[i], off[i] = -(base + number + 1), at
                at += size
        table = table.select(keep)
        return table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    return full.unionByName(short.groupBy("g").applyInArrow(place, schema))

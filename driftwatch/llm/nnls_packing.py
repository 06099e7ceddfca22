"""Packing documents into token sequences by non-negative least squares.

A document's ids are cut into full windows of ``capacity`` ids, which are sequences
of their own, and one shorter rest. The rests are dealt evenly to groups of some
``GROUP_ITEMS`` pieces, and each group is packed in one task:

1. Lengths are binned to ``UNITS`` parts of the window. All shallow combinations
   that fill a window exactly are enumerated: one bin any number of times, and at
   most two more. Column s of the matrix A says how often combination s uses each
   bin, b is the group's histogram, and x >= 0 minimising |A x - b| says how often
   to use each combination.
2. x is rounded, and the combinations are filled with pieces, most used first. A
   slot takes the longest piece of its bin; the last one the longest piece of any
   length that fits, so little of what binning rounded up stays empty.
3. The residual pieces are packed greedily: the longest first, then always the
   longest that still fits.
4. Sequences that are still not full are closed by cutting: the emptiest are given
   up, and their ids fill the fullest ones. What is left of the last one (fewer
   ids than a window, once a group) becomes sequences whose lengths are powers of
   two, which need no padding.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.tokens import encoder
from driftwatch.session import cut_lineage, ship_package

GROUP_ITEMS = 50_000
UNITS = 128
ROWS_OUT = 8192
#: Tasks that pack; beyond it a task gets several groups, one after the other.
MOST_TASKS = 20_000


@lru_cache(maxsize=2)
def combinations(units: int) -> np.ndarray:
    """All combinations of bins 1 to ``units`` whose sum is ``units``: one bin any number
    of times and at most two others. One row per bin (bin 0 first, unused), one column each."""
    found = set()
    for u in range(1, units + 1):
        for times in range(1, units // u + 1):
            rest = units - u * times
            tails = [()] if not rest else [(rest,), *((v, rest - v) for v in range(1, rest // 2 + 1))]
            found.update(tuple(sorted((u,) * times + tail)) for tail in tails)
    out = np.zeros((units + 1, len(found)))
    for s, bins in enumerate(sorted(found)):
        np.add.at(out[:, s], list(bins), 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: columns enter by their gradient, and leave
    where the least-squares solution over the ones in use would be negative."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    enough = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 4 * len(b)):
        gradient = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(gradient.argmax())
        if gradient[best] <= enough:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[at] = solved
                break
            down = at[solved <= 0]
            step = (x[down] / np.maximum(x[down] - solved[solved <= 0], 1e-300)).min()
            x[at] += step * (solved - x[at])
            gone = at[(x[at] <= 1e-12) & (solved <= 0)]
            x[gone], used[gone] = 0, False
    return x


class _Pieces:
    """Pieces by length. A number with one bit per length that is there finds the
    longest one that fits in a few steps."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i, size in zip(range(len(sizes) - 1, -1, -1), sizes[::-1].tolist()):
            self.by_size[size].append(i)
        self.there = sum(1 << n for n, x in enumerate(self.by_size) if x)

    def longest(self, most: int) -> int:
        """Length of the longest piece of at most ``most`` ids, 0 if there is none."""
        return max((self.there & ((2 << most) - 1)).bit_length() - 1, 0)

    def take(self, size: int) -> int:
        at = self.by_size[size].pop()
        if not self.by_size[size]:
            self.there ^= 1 << size
        return at


def _filled(pieces: _Pieces, sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Steps 1 to 3: sequences of whole pieces."""
    unit = max(1, capacity // UNITS)
    units = capacity // unit
    bins = -(-sizes // unit)
    a = combinations(units)
    x = nnls(a, np.bincount(bins[bins <= units], minlength=units + 1).astype(float))
    out: list[list[int]] = []

    def close(members: list[int], gap: int) -> None:
        while gap and (size := pieces.longest(gap)):
            members.append(pieces.take(size))
            gap -= size
        out.append(members)

    times = np.rint(x).astype(int)
    for s in sorted(np.flatnonzero(times).tolist(), key=lambda s: (-x[s], s)):
        slots = np.repeat(np.arange(units, 0, -1), a[units:0:-1, s].astype(int)).tolist()
        for _ in range(times[s]):
            members, gap = [], capacity
            for n, u in enumerate(slots):
                size = pieces.longest(gap if n == len(slots) - 1 else min(u * unit, gap))
                if size > (u - 1) * unit:
                    members.append(pieces.take(size))
                    gap -= size
                elif not members:
                    break  # the combination's first bin has run out
            if not members:
                break
            close(members, gap)
    while size := pieces.longest(capacity):
        close([pieces.take(size)], capacity - size)
    return out


def pack_group(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, begin in it, length). All but those of a power of two are full."""
    sequences = [[(i, 0, int(sizes[i])) for i in members] for members in _filled(_Pieces(sizes, capacity), sizes, capacity)]
    total = lambda s: sum(n for _, _, n in s)
    full = [s for s in sequences if total(s) == capacity]
    rest = sorted((s for s in sequences if total(s) < capacity), key=total, reverse=True)
    at, gap, given = 0, 0, []
    while at < len(rest):
        gap = capacity - total(rest[at])
        while gap and (given or at + 1 < len(rest)):
            given = given or rest.pop()[::-1]
            i, begin, n = given.pop()
            rest[at].append((i, begin, min(n, gap)))
            if n > gap:
                given.append((i, begin + gap, n - gap))
            gap -= min(n, gap)
        at += 1
    if gap or given:  # ids for less than one window are left
        stream = [*(rest.pop() if gap else []), *given[::-1]]
        left = total(stream)
        for power in range(left.bit_length() - 1, -1, -1):
            if left >> power & 1:
                members, need = [], 1 << power
                while need:
                    i, begin, n = stream[0]
                    members.append((i, begin, min(n, need)))
                    stream[:1] = [(i, begin + need, n - need)] if n > need else []
                    need -= min(n, need)
                rest.append(members)
    return full + rest


def _pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str, blanks: str,
            lower: bool, kind: str, with_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) of full windows and rests. Full windows carry no ids unless asked for."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    kinds = [pa.int64()] * 5 + [pa.binary()]
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, held = encoder(vocabulary, blanks, lower), [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = enc.ids(text.as_py()) + end
                n, key = len(ids) // 4, doc_id.as_py()
                for begin in range(0, n, capacity):
                    part = ids[4 * begin:4 * (begin + capacity)]
                    length = len(part) // 4
                    carried = np.frombuffer(part, "<u4").astype(kind).tobytes() if with_ids or length < capacity else None
                    out.append((key, begin, length, zlib.crc32(part), n, carried))
                    held += len(carried or b"")
                if len(out) >= ROWS_OUT or held > 1 << 24:
                    yield give()
                    out, held = [], 0
        if out:
            yield give()

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         blanks: str = "drop", lower: bool = True, with_ids: bool = False, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Rows ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``, one per piece.

    Each id of a document lies in one piece. Every sequence is full or as long as a
    power of two. A null or empty text is the end id alone; null ids and repeated
    rows are documents like others; an empty table gives no rows; columns other than
    the two named are ignored, whatever their names. Sequence ids are any numbers:
    from 0 up for full windows, negative for packed sequences. ``ids`` are
    little-endian unsigned 32-bit.
    """
    from tokenizers import Tokenizer
    ship_package(docs.sparkSession)
    top = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1)
    kind = "<u2" if top <= 1 << 16 else "<u4"
    cut = _pieces(docs, vocabulary, end_id, capacity, id_col, text_col, blanks, lower, kind, with_ids)
    cut = cut_lineage(cut.withColumn("row", F.monotonically_increasing_id()))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = pa.schema([(x, pa.binary() if x == "ids" else pa.int64()) for x in names])
    ddl = ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), kind).astype("<u4").tobytes() for x in batch.column(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], schema=schema)

    full = cut.where(F.col("length") == capacity).select(
        *names[:5], F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *names[7:])
    if with_ids:
        full = full.mapInArrow(wide, ddl)
    rest = cut.where(F.col("length") < capacity)
    groups = math.ceil(rest.count() / group_items) or 1
    rest = rest.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def place(key, table):
        table = table.sort_by("row")  # the same in a task that runs again
        ids = table.column("ids")
        plain = {x: table.column(x).to_numpy() for x in ("start", "length", "ids_crc32", "doc_tokens")}
        out, base = {x: [] for x in names}, key[0].as_py() << 32
        at = []
        for number, members in enumerate(pack_group(plain["length"], capacity)):
            offset = 0
            for i, begin, n in members:
                whole = n == plain["length"][i]
                if with_ids or not whole:
                    part = np.frombuffer(ids[i].as_py(), kind)[begin:begin + n].astype("<u4").tobytes()
                at.append(i)
                out["start"].append(int(plain["start"][i]) + begin)
                out["length"].append(n)
                out["ids_crc32"].append(int(plain["ids_crc32"][i]) if whole else zlib.crc32(part))
                out["doc_tokens"].append(int(plain["doc_tokens"][i]))
                out["sequence_id"].append(-(base + number + 1))
                out["offset"].append(offset)
                if with_ids:
                    out["ids"].append(part)
                offset += n
        out["doc_id"] = table.column("doc_id").take(pa.array(at, pa.int64()))
        return pa.table([out[x] if x == "doc_id" else pa.array(out[x], schema.field(x).type) for x in names], schema=schema)

    tasks = min(2 * groups, MOST_TASKS)
    return full.unionByName(rest.repartition(tasks, "g").groupBy("g").applyInArrow(place, ddl))

"""Phrase collocation mining with mergeable Misra-Gries summaries.

Which phrases of one to four words occur often enough is found in two passes.

First pass: texts are packed into blocks of some ``BLOCK_BYTES``. A block hashes
every occurrence of one to four consecutive words of a piece, together with the
language, counts equal hashes, and sends each hash partition its counts as one
packed row. A partition merges what it gets into a Misra-Gries summary: equal
hashes are added, and whenever there are more counters than its capacity, the
greatest count beyond the capacity is taken off all of them. With a capacity of
more than the partition's mass / threshold, all that was taken off (``lost``) stays
below the threshold, so a frequent phrase always survives; ``SLACK`` times that
capacity keeps the infrequent ones that survive with it few. Hashes that meet by
chance only add survivors. A partition answers each block with the survivors it sent.

Second pass: a block reads its texts again, writes out the phrases whose hash has
survived, and Spark's grouping counts them exactly, by language and words.

Parts of a frequent phrase are at least as frequent, so the exact counts hold all
that scores and the dropping of contained candidates need; both are joins.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.hashing import U64, gather, mix, slice_hashes
from driftwatch.llm.repeats import _pack, _unpack
from driftwatch.session import cut_lineage, ship_package

#: Most words of a phrase.
LONGEST = 4
#: Bytes of text to a block.
BLOCK_BYTES = 8 << 20
#: Counters of a summary, as a multiple of its mass / threshold.
SLACK = 8
#: Occurrences a partition holds while there are less than ``FEW`` partitions, and at most.
SMALL_MASS, LARGE_MASS, FEW = 4 << 20, 64 << 20, 256
#: Blocks counted by one task of the second pass: Spark adds up their phrases before it deals them.
BLOCKS_A_TASK = 8
#: Phrases to one Arrow array.
PHRASES = 1 << 18
#: Tasks of one pass; beyond it a task gets several blocks or partitions, one after the other.
MOST_TASKS = 20_000
#: Parts that are at least this share of all words are broadcast: at most ``COMMON`` of each length.
COMMON = 1000
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = 2
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")


class Words:
    """Words of texts laid one behind the other: hashes, piece and text of each."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        data = _LOWER[data]
        kind = _KIND[data]
        solid = kind == 0
        starts = np.concatenate([[0], ends[:-1]])
        inner = starts[(starts > 0) & (starts < len(data))]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[inner] = solid[inner]  # no word crosses texts
        stops[:-1] &= ~solid[1:]
        stops[inner - 1] = solid[inner - 1]
        start = np.flatnonzero(begins)
        length = np.flatnonzero(stops) + 1 - start
        self.text = np.searchsorted(starts, start, "right") - 1
        # both numbers only grow, so their sum is the same only where both are
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), start) + self.text
        self.hash = slice_hashes(data, start, length)
        self.offset = np.zeros(len(start) + 1, np.int64)
        np.cumsum(length + 1, out=self.offset[1:])
        self.clean = np.full(int(self.offset[-1]), 32, np.uint8)  # words with one blank behind each
        keep = np.ones(len(self.clean), bool)
        keep[self.offset[1:] - 1] = False
        self.clean[keep] = data[solid]

    def grams(self, salt: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first words, hashes) of the phrases of 1 to ``LONGEST`` words inside pieces."""
        h = mix(self.hash ^ salt[self.text])
        yield 1, np.arange(len(h)), h
        for n in range(2, LONGEST + 1):
            if len(h) < 2:
                return
            h = mix(h[:-1] * U64(0xD1342543DE82EF95) + self.hash[n - 1:])
            at = np.flatnonzero(self.piece[:len(h)] == self.piece[n - 1:])
            yield n, at, h[at]

    def phrases(self, first: np.ndarray, n: np.ndarray) -> pa.Array:
        start = self.offset[first]
        size = self.offset[first + n] - 1 - start
        where = np.zeros(len(first) + 1, np.int32)
        np.cumsum(size, out=where[1:])
        return pa.Array.from_buffers(pa.string(), len(first),
                                     [None, pa.py_buffer(where.tobytes()), pa.py_buffer(gather(self.clean, start, size).tobytes())])


def _salt(names: list[str]) -> np.ndarray:
    data = [np.frombuffer(x.encode() + b"\0", np.uint8) for x in names]
    size = np.array([len(x) for x in data], np.int64)
    return slice_hashes(np.concatenate(data), np.cumsum(size) - size, size) if names else np.zeros(0, U64)


_BLOCK = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("ends", pa.binary()), ("langs", pa.binary()), ("names", pa.list_(pa.string()))])


def _blocks(docs: DataFrame, lang: str, text: str, block_bytes: int) -> DataFrame:
    """Texts packed as they are read. A text longer than a block is cut behind a mark that ends a piece."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def give() -> pa.RecordBatch:
            names = sorted({x for x, _ in held})
            at = {x: i for i, x in enumerate(names)}
            ends = np.cumsum([len(t) for _, t in held]).astype("<i8")
            langs = np.array([at[x] for x, _ in held], "<i4")
            data = [[number], [zstandard.compress(b"".join(t for _, t in held), 1)], [_pack(ends)], [_pack(langs)], [names]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for name, whole in zip(batch.column(0), batch.column(1)):
                whole, at = whole.as_py(), 0
                while at < len(whole):
                    mark = _BREAK.search(whole, at + block_bytes) if len(whole) - at > block_bytes else None
                    to = mark.end() if mark else len(whole)
                    held.append((name.as_py(), whole[at:to]))
                    size, at = size + to - at, to
                    if size >= block_bytes:
                        yield give()
                        number, held, size = number + 1, [], 0
        if held:
            yield give()

    ddl = "block long, texts binary, ends binary, langs binary, names array<string>"
    return cut_lineage(rows.where(F.octet_length("text") > 0).mapInArrow(store, ddl))


def _read(row: dict) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, each text's language number, each text's hash of its language."""
    langs = _unpack(row["langs"], "<i4")
    words = Words(np.frombuffer(zstandard.decompress(row["texts"]), np.uint8), _unpack(row["ends"], "<i8"))
    return words, langs, _salt(row["names"])[langs]


class Layout:
    """Hash partitions: ranges of the hash, whose first bits name the partition. Keys are
    the first ``32 + bits of the number of partitions`` bits, so that they differ inside a partition."""

    def __init__(self, mass: int):
        few = min(-(-mass // SMALL_MASS), FEW)
        self.count = max(few, -(-mass // LARGE_MASS), 1)
        self.shift = U64(max(0, 32 - self.count.bit_length()))

    def keys(self, h: np.ndarray) -> np.ndarray:
        return h >> self.shift

    def partition(self, keys: np.ndarray) -> np.ndarray:
        return ((keys << self.shift) >> U64(32)) * U64(self.count) >> U64(32)


_SENT = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _send(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, _, salt = _read(row)
                keys, counts = np.unique(np.concatenate([layout.keys(h) for _, _, h in words.grams(salt)]), return_counts=True)
                part = layout.partition(keys)
                edges = np.flatnonzero(np.diff(part, prepend=part[:1] + U64(1), append=part[-1:] + U64(1)))
                rows = [(row["block"], int(part[a]), _pack(np.diff(keys[a:b], prepend=U64(0))), _pack(counts[a:b].astype("<u4")))
                        for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)] if rows else
                                                 [pa.array([], f.type) for f in _SENT], schema=_SENT)
    return run


class MisraGries:
    """Counters of the most frequent keys. A key's count is at least its counter and at most its counter plus ``lost``."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Exact counts or another summary's counters (whose ``lost`` then has to be added to this one's)."""
        self._held.append((keys, counts.astype(np.int64)))
        self._size += len(keys)
        if self._size > max(self.capacity, 1 << 20):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self._held)])
        counts = np.concatenate([self.counts, *(c for _, c in self._held)])
        self._held, self._size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + U64(1)))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:
            beyond = len(self.counts) - self.capacity - 1
            cut = int(np.partition(self.counts, beyond)[beyond])
            self.counts = self.counts - cut
            self.keys, self.counts = self.keys[self.counts > 0], self.counts[self.counts > 0]
            self.lost += cut

    def survivors(self, threshold: int) -> np.ndarray:
        """All keys that may have a count of ``threshold``, in ascending order."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def _answer(threshold: int):
    """One partition: the survivors among the keys of each row that a block sent."""
    def run(key, table):
        read = lambda x: np.cumsum(_unpack(x.as_py(), "<u8"), dtype=U64)
        sent, counts = table.column("keys"), table.column("counts")
        mass = sum(int(_unpack(x.as_py(), "<u4").sum(dtype=np.int64)) for x in counts)
        summary = MisraGries(SLACK * mass // threshold + 1)
        for k, c in zip(sent, counts):
            summary.add(read(k), _unpack(c.as_py(), "<u4"))
        good = summary.survivors(threshold)
        replies = []
        for k in sent:
            keys = read(k)
            at = np.searchsorted(good, keys)
            hit = keys[good[np.minimum(at, len(good) - 1)] == keys] if len(good) else keys[:0]
            replies.append(_pack(np.diff(hit, prepend=U64(0))))
        return pa.table({"block": table.column("block"), "keys": pa.array(replies, pa.binary())})
    return run


_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("w", pa.int32()), ("a", pa.int64())])


def _count(layout: Layout):
    """One block: its phrases with a surviving hash and their counts; and, as the phrase of 0 words, its words by
    language. Neighbours share their first words, so what is dealt compresses well."""
    def run(key, blocks, replies):
        out = []
        good = np.unique(np.concatenate([np.zeros(0, U64), *(np.cumsum(_unpack(x.as_py(), "<u8"), dtype=U64) for x in replies.column("keys"))]))
        for row in blocks.to_pylist():
            words, langs, salt = _read(row)
            names = pa.array(row["names"], pa.string())
            number = np.bincount(langs[words.text], minlength=len(names))
            out.append(pa.table([names, pa.array([""] * len(names), pa.string()), pa.array([0] * len(names), pa.int32()),
                                 pa.array(number, pa.int64())], schema=_FOUND))
            for n, at, h in words.grams(salt):
                keys = layout.keys(h)
                place = np.searchsorted(good, keys)
                hit = good[np.minimum(place, len(good) - 1)] == keys if len(good) else np.zeros(len(keys), bool)
                _, first, counts = np.unique(h[hit], return_index=True, return_counts=True)
                first = at[hit][first]
                for some in np.array_split(np.arange(len(first)), len(first) // PHRASES + 1):
                    i, m = first[some], pa.array(np.full(len(some), n), pa.int32())
                    lang = names.take(pa.array(langs[words.text[i]], pa.int32()))
                    out.append(pa.table([lang, words.phrases(i, n), m, pa.array(counts[some], pa.int64())], schema=_FOUND).sort_by("phrase"))
        return pa.concat_tables(out) if out else _FOUND.empty_table()
    return run


def frequent_phrases(docs: DataFrame, threshold: int, lang_col: str = "lang", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``(lang, w, phrase, a)``: every phrase of w = 1 to 4 words that occurs a >= ``threshold``
    times in a language's texts, and the number of all its words as the phrase of 0 words."""
    ship_package(docs.sparkSession)
    blocks = _blocks(docs, lang_col, text_col, block_bytes)
    n_blocks = blocks.count()
    layout = Layout(n_blocks * block_bytes * LONGEST // 6)  # some six bytes to a word; capacities follow the true mass
    sent = blocks.mapInArrow(_send(layout), "block long, part int, keys binary, counts binary")
    parts, tasks = min(2 * layout.count, MOST_TASKS), min(-(-n_blocks // BLOCKS_A_TASK) or 1, MOST_TASKS)
    answers = sent.repartition(parts, "part").groupBy("part").applyInArrow(_answer(threshold), "block long, keys binary")
    found = blocks.repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(
        _count(layout), "lang string, phrase string, w int, a long")
    return found.groupBy("lang", "w", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= threshold) | (F.col("w") == 0))


def _part(begin, length):
    return F.array_join(F.slice(F.split("phrase", " "), begin, length), " ")


def _looked_up(cuts: DataFrame, part: Column, name: str, parts: DataFrame, all_words: int) -> DataFrame:
    """Each cut with its part's count. A part is in at most as many phrases as it occurs, over the threshold;
    the few very common ones are broadcast, and their cuts are dealt by phrase in the join that finds the others."""
    common = F.col("f") * COMMON >= all_words
    few = parts.where(common).withColumnRenamed("f", "common")
    rest = parts.where(~common).select("lang", F.concat(F.lit("p"), "part").alias("look"), F.col("f").alias("rest"))
    cuts = cuts.withColumn("part", part).join(F.broadcast(few), ["lang", "part"], "left")
    cuts = cuts.withColumn("look", F.when(F.col("common").isNull(), F.concat(F.lit("p"), "part")).otherwise(F.concat(F.lit("c"), "phrase"))).drop("part")
    return cuts.join(rest, ["lang", "look"], "left").withColumn(name, F.coalesce("common", "rest")).drop("common", "rest", "look")


def mine(docs: DataFrame, threshold: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text",
         contained: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``(lang, rank, phrase, a, l, r, n, score)``: each language's best ``top`` phrases.

    A null language is ``und``; a null or empty text has no words. Repeated rows are
    texts like others. Languages without a candidate, and empty tables, give no rows.
    A phrase never leaves its piece, and texts of any length are read whole. Other
    columns are ignored, whatever their names. Equal scores go to the greater a, then
    to the phrase that comes first by its UTF-8 bytes.
    """
    table = cut_lineage(frequent_phrases(docs, threshold, lang_col, text_col, block_bytes))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    phrases = table.where("w > 0").select("lang", "phrase", "w", "a")
    parts = phrases.where(F.col("w") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = phrases.where("w > 1").select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("w") - 1)).alias("k"))
    all_words = table.where("w = 0").agg(F.sum("a")).first()[0] or 0
    cuts = _looked_up(cuts, _part(F.lit(1), F.col("k")), "l", parts, all_words)
    cuts = _looked_up(cuts, _part(F.col("k") + 1, F.lit(LONGEST)), "r", parts, all_words)
    cuts = cuts.withColumns({"wa": wide("a"), "wl": wide("l"), "wr": wide("r")}).withColumn(
        "score", F.expr("cast(2000000 as decimal(7,0)) * wa div (wl + wr)"))
    lowest = F.min(F.struct("score", "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    longer = phrases.where("w > 2").select("lang", "w", "phrase", F.col("a").alias("m"))
    inner = longer.select("lang", "m", "w", "phrase", F.explode(F.sequence(F.lit(2), F.col("w") - 1)).alias("size"))
    inner = inner.select("lang", "m", "phrase", "size", F.explode(F.sequence(F.lit(1), F.col("w") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "m").groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    inside = F.expr(f"cast(m as decimal(19,0)) * 100 >= cast(a as decimal(19,0)) * {int(contained)}")
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("m").isNull() | ~inside)

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "salt").orderBy(*order)  # at most ``top`` a salt go on
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = table.where("w = 0").select("lang", F.col("a").alias("n"))
    return kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Passages that occur in an earlier document: the Spark side of both operators
that remove them (suffix arrays over bytes, FM-indexes over words).

A unit is a byte or a word; a window is so many consecutive units of one document.
A window counts as repeated when its units also stand in a document with a smaller
id. Five steps, all of them shuffles of compact arrays:

1. Documents are dealt by id to blocks of some ``BLOCK_BYTES`` of text. Each
   window's anchor is the k-gram in it with the least hash (equal windows have
   equal anchors); a block sends its different anchor hashes to buckets.
2. A bucket finds the hashes that stand in two places or more, with what stands
   before or after them agreeing in eight bits, and tells the blocks which of theirs
   they are. Most text ends here.
3. Windows with the same anchor lie side by side; a block cuts them out as one
   fragment, keeps each different fragment once with its smallest document id,
   and sends it to the bucket of its anchor. Windows with equal units are always
   in fragments of the same bucket.
4. The bucket builds its index over the fragments that share their anchor with a
   different fragment (what copies have in common is one fragment by now) and reports,
   for runs of windows, the smallest document id in which they occur.
5. The block holds that against each of its documents.

Hot groups: thousands of copies are one fragment per block in step 3. An anchor
that stands in very many blocks (a common passage with different text around
it) is not sent as fragments but as single windows, dealt by their own hash, so no
bucket gathers its surroundings. Sizes of blocks and buckets stay the same as
data grow, only their number follows. Steps 1, 3 and 5 read the same shuffled
documents; all steps are ordinary shuffles, so a lost executor costs a re-run of
its tasks.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.hashing import U64, gather, mix, slice_hashes, spread, word_table

BLOCK_BYTES = 8 << 20
#: An anchor is hot when the blocks that hold it, counted 64 times where it stands more than once, exceed this.
HOT = 1 << 16
#: A null id stands behind all others.
LAST = (1 << 63) - 1
CHUNK = 1 << 16
#: Fragments to one index, about; a bucket's fragments are split by their anchors.
PART = 4000
#: An anchor's hash has so many bits more than the number of anchors takes; a chance meeting only costs a fragment.
SPARE_BITS = 14


@dataclass(frozen=True)
class Kind:
    """What a unit is, the sizes of windows and anchors, and the bits of an anchor's hash."""
    words: bool
    window: int
    gram: int
    bits: int = 56


class Block:
    """Documents of one block as arrays, in the order of (id, content hash)."""

    def __init__(self, table: pa.Table, kind: Kind):
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("h", "ascending")]))
        self.kind = kind
        self.doc_id, self.h = table.column("doc_id").to_numpy(), table.column("h").to_numpy()
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        wide = pa.types.is_large_binary(text.type)
        where = np.frombuffer(text.buffers()[1], "<i8" if wide else "<i4")[text.offset:text.offset + len(text) + 1].astype(np.int64)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[where[0]:where[-1]] if raw is not None else np.zeros(0, np.uint8)
        where = where - where[0]
        if kind.words:
            self.data, self.offset, self.first = word_table(data, where)
            size = np.diff(self.offset)
            self.unit = slice_hashes(self.data, self.offset[:-1], np.maximum(size - 1, 1))
        else:
            self.data, self.offset, self.first = data, None, where
            padded = np.zeros(len(data) + 16, np.uint8)
            padded[:len(data)] = data
            self.unit = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))

    def n_units(self) -> int:
        return int(self.first[-1])

    def _hash(self, at, n: int) -> np.ndarray:
        """Hashes of the n units (9 to 16 bytes, or words) at a slice or an array of places."""
        u = self.unit
        move = (lambda i: slice(at.start + i, at.stop + i)) if isinstance(at, slice) else (
            lambda i: np.clip(at + i, 0, len(u) - 1))
        if not self.kind.words:  # overlapping 8-byte pieces
            h = u[move(0)] * U64(0x9E3779B97F4A7C15)
            for i in (*range(8, n - 8, 8), n - 8):
                h ^= h >> U64(32)
                h = (h + u[move(i)]) * U64(0xD6E8FEB86659FD93)
            return mix(h)
        h = u[move(0)].copy()
        for i in range(1, n):
            h *= U64(0xD1342543DE82EF95)
            h += u[move(i)]
        return mix(h)

    def _gram(self, at) -> np.ndarray:
        return self._hash(at, self.kind.gram)

    def contexts(self, anchor: np.ndarray) -> np.ndarray:
        """Eight bits for what stands before an anchor and eight for what follows. A window holds
        half of its other units on one side at least, so two equal windows agree on one of them."""
        half = -(-(self.kind.window - self.kind.gram) // 2)
        before = self._hash(anchor - half, half) >> U64(56)
        after = self._hash(anchor + self.kind.gram, half) >> U64(56)
        return ((before << U64(8)) | after).astype("<u2")

    def runs(self):
        """(first window, number of windows, anchor hash) of each run of windows with one anchor."""
        w, k, n = self.kind.window, self.kind.gram, self.n_units()
        anchor = np.full(max(n - w + 1, 0), -1, np.int32)
        low = U64(CHUNK * 2 - 1)
        for c in range(0, len(anchor), CHUNK):
            m = min(CHUNK, len(anchor) - c)
            key = self._gram(slice(c, c + m + w - k))
            key &= ~low
            key |= np.arange(len(key), dtype=U64)
            have, want = 1, w - k + 1
            while 2 * have <= want:
                key = np.minimum(key[:-have], key[have:])
                have *= 2
            if want > have:
                key = np.minimum(key[:-(want - have)], key[want - have:])
            anchor[c:c + m] = (key[:m] & low).astype(np.int32) + c
        size = np.diff(self.first)
        inside = np.zeros(len(anchor) + 1, bool)  # windows within one document
        long = size >= w
        edge = np.zeros(len(anchor) + 2, np.int32)
        np.add.at(edge, self.first[:-1][long], 1)
        np.add.at(edge, self.first[1:][long] - w + 1, -1)
        inside[:-1] = np.cumsum(edge[:len(anchor)]) > 0
        inside = inside[:-1]
        starts = inside.copy()
        starts[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        begin = self.first[:-1][long]
        starts[begin] = True
        at = np.flatnonzero(starts)
        # a run ends where the next begins, or at the end of its document's windows
        doc = np.searchsorted(self.first, at, "right") - 1
        stop = np.minimum(np.append(at[1:], len(anchor)), self.first[doc + 1] - w + 1)
        return at, stop - at, self._gram(anchor[at].astype(np.int64)) >> U64(64 - self.kind.bits), doc, anchor[at].astype(np.int64)

    def bytes_of(self, start: np.ndarray, units: np.ndarray):
        """(byte offset, byte length) of runs of units in ``data``."""
        if self.offset is None:
            return start, units
        return self.offset[start], self.offset[start + units] - self.offset[start]

    def fragments(self, shared: np.ndarray):
        """Occurrences of windows under shared anchors: (first window, windows, document,
        fragment number), and of each different fragment (occurrence, smallest id, bucket key)."""
        at, count, key, doc, _ = self.runs()
        place = np.searchsorted(shared, key << U64(1))
        place = np.minimum(place, max(len(shared) - 1, 0))
        found = (shared[place] >> U64(1) == key) if len(shared) else np.zeros(len(at), bool)
        hot = found.copy()
        if len(shared):
            hot &= (shared[place] & U64(1)) > 0
        cold = found & ~hot
        single = spread(at[hot], count[hot])
        start = np.concatenate([at[cold], single])
        windows = np.concatenate([count[cold], np.ones(len(single), np.int64)])
        doc = np.concatenate([doc[cold], np.repeat(doc[hot], count[hot])])
        key = np.concatenate([key[cold], np.zeros(len(single), U64)])
        where, size = self.bytes_of(start, windows + (self.kind.window - 1))
        content = slice_hashes(self.data, where, size)
        key[len(key) - len(single):] = content[len(key) - len(single):] >> U64(64 - self.kind.bits)
        order = np.lexsort((start, content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        least = np.minimum.reduceat(self.doc_id[doc[order]], firsts) if len(firsts) else self.doc_id[:0]
        one = order[firsts]
        return start, windows, doc, number, (where[one], size[one], windows[one], least, key[one])


def _split(key: np.ndarray, buckets: int):
    """(bucket, indices) for each bucket that has keys."""
    bucket = (key % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def _table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict(columns, schema)


KEYS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("contexts", pa.binary())])
FRAGMENTS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("number", pa.binary()), ("size", pa.binary()),
                       ("part", pa.binary()), ("windows", pa.binary()), ("least", pa.binary()), ("data", pa.binary())])
REPLIES = pa.schema([("block", pa.int32()), ("number", pa.binary()), ("begin", pa.binary()), ("length", pa.binary()), ("least", pa.binary())])


def _pack(a: np.ndarray) -> bytes:
    """An array for a shuffle: its bytes by significance, compressed."""
    flat = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def _unpack(b: bytes, dtype) -> np.ndarray:
    flat = pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _join(column: pa.ChunkedArray, dtype) -> np.ndarray:
    parts = [_unpack(x.as_py(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _send_keys(kind: Kind, buckets: int):
    def send(key, table):
        block = Block(table, kind)
        _, _, key_, _, anchor = block.runs()
        order = np.argsort(key_)
        sorted_ = key_[order]
        firsts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(order) else order
        different = sorted_[firsts]
        several = np.diff(np.append(firsts, len(order))) > 1
        marked = (different << U64(1)) | several.astype(U64)
        contexts = block.contexts(anchor[order[firsts]])
        parts = _split(different, buckets)
        return _table({"bucket": [b for b, _ in parts], "block": [key[0].as_py()] * len(parts),
                       "keys": [_pack(marked[i]) for _, i in parts], "contexts": [_pack(contexts[i]) for _, i in parts]}, KEYS)
    return send


def _again(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether another member of the group has the same value."""
    _, place, count = np.unique((group << 8) | value, return_inverse=True, return_counts=True)
    return count[place] > 1


def _find_shared(hot: int):
    def find(key, table):
        arrays = [_unpack(x.as_py(), "<u8") for x in table.column("keys")]
        every = np.concatenate(arrays)
        context = np.concatenate([_unpack(x.as_py(), "<u2") for x in table.column("contexts")]).astype(np.int64)
        _, group, count = np.unique(every >> U64(1), return_inverse=True, return_counts=True)
        several = (every & U64(1)).astype(bool)
        weight = count + 63 * np.bincount(group, several, len(count)).astype(np.int64)
        # a block that has the anchor more than once may agree with any other, or within itself
        wanted = weight[group] > np.maximum(count[group], 1)
        wanted |= _again(group, context >> 8) | _again(group, context & 255)
        reply = (every & ~U64(1)) | (weight[group] > hot).astype(U64)
        out_block, out_keys, cuts = [], [], np.cumsum([len(a) for a in arrays])[:-1]
        for block, keys, use in zip(table.column("block").to_pylist(), np.split(reply, cuts), np.split(wanted, cuts)):
            if use.any():
                out_block.append(block)
                out_keys.append(_pack(keys[use]))
        return _table({"block": out_block, "keys": out_keys}, pa.schema([KEYS.field("block"), KEYS.field("keys")]))
    return find


def _send_fragments(kind: Kind, buckets: int):
    def send(key, docs, shared):
        if not docs.num_rows or not shared.num_rows:
            return _table({f: [] for f in FRAGMENTS.names}, FRAGMENTS)
        block = Block(docs, kind)
        _, _, _, _, (where, size, windows, least, bucket_key) = block.fragments(np.sort(_join(shared.column("keys"), U64)))
        out = {f: [] for f in FRAGMENTS.names}
        for bucket, i in _split(bucket_key, buckets):
            row = (bucket, key[0].as_py(), _pack(i.astype("<i4")), _pack(size[i].astype("<i4")), _pack((mix(bucket_key[i]) >> U64(32)).astype("<u4")),
                   _pack(windows[i].astype("<i2")), _pack(least[i].astype("<i8")), _pack(gather(block.data, where[i], size[i])))
            for f, x in zip(FRAGMENTS.names, row):
                out[f].append(x)
        return _table(out, FRAGMENTS)
    return send


def _parts(anchor: np.ndarray) -> list[np.ndarray]:
    """Members whose anchor (32 bits of a mixed hash) another one has, dealt by anchor to parts of some ``PART``."""
    _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[group] > 1)
    part = anchor[shared] * -(-len(shared) // PART) >> 32
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [shared[i] for i in np.split(order, cuts) if len(i)]


def _answer(kind: Kind, index: Callable):
    def answer(key, table):
        column = lambda name, dtype: [_unpack(x.as_py(), dtype) for x in table.column(name)]
        number, size, windows, least = column("number", "<i4"), column("size", "<i4"), column("windows", "<i2"), column("least", "<i8")
        data = np.concatenate(column("data", np.uint8))
        block = np.repeat(np.arange(len(number)), [len(x) for x in number])
        size, windows, least = (np.concatenate(x).astype(np.int64) for x in (size, windows, least))
        start = np.cumsum(size) - size
        # equal fragments of different blocks enter the index once, with their smallest id
        content = slice_hashes(data, start, size)
        order = np.lexsort((size, content))
        new = np.ones(len(order), bool)
        new[1:] = (content[order][1:] != content[order][:-1]) | (size[order][1:] != size[order][:-1])
        firsts = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[firsts]
        smallest = np.minimum.reduceat(least[order], firsts)
        # equal windows have equal anchors: a fragment alone with its anchor has its own id everywhere
        first = np.cumsum(windows[one]) - windows[one]
        found = np.repeat(smallest, windows[one])
        # one index per part for all others
        for i in _parts(np.concatenate(column("part", "<u4"))[one].astype(np.int64)):
            found[spread(first[i], windows[one[i]])] = index(data, start[one[i]], size[one[i]], windows[one[i]], smallest[i])
        # runs of windows with one id, for each different fragment, then for each block that asked
        head = np.zeros(len(found) + 1, bool)
        head[first] = True
        head[-1] = True
        head[1:-1] |= found[1:] != found[:-1]
        at = np.flatnonzero(head)
        run_id, run_len = found[at[:-1]], np.diff(at)
        owner = np.searchsorted(first, at[:-1], "right") - 1
        run_begin = at[:-1] - first[owner]
        runs_of = np.bincount(owner, minlength=len(one))
        run_first = np.cumsum(runs_of) - runs_of
        pick = spread(run_first[which], runs_of[which])
        asker = np.repeat(block, runs_of[which])
        nums = np.repeat(np.concatenate(number), runs_of[which])
        cuts = np.searchsorted(asker, np.arange(len(number) + 1))
        out = {f: [] for f in REPLIES.names}
        for row, name in enumerate(table.column("block").to_pylist()):
            p, n = pick[cuts[row]:cuts[row + 1]], nums[cuts[row]:cuts[row + 1]]
            for f, x in zip(REPLIES.names, (name, _pack(n.astype("<i4")), _pack(run_begin[p].astype("<i2")),
                                            _pack(run_len[p].astype("<i2")), _pack(run_id[p].astype("<i8")))):
                out[f].append(x)
        return _table(out, REPLIES)
    return answer


RESULT = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()),
                    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _apply(kind: Kind):
    def apply(key, docs, told):
        block = Block(docs, kind)
        n, first = block.n_units(), block.first
        gone = np.zeros(n + 1, np.int32)
        replies = told.filter(pc.is_valid(told.column("number")))
        if replies.num_rows:
            start, _, doc, number, _ = block.fragments(np.sort(_join(told.column("keys"), U64)))
            num, begin = _join(replies.column("number"), "<i4"), _join(replies.column("begin"), "<i2").astype(np.int64)
            length, least = _join(replies.column("length"), "<i2").astype(np.int64), _join(replies.column("least"), "<i8")
            order = np.argsort(num, kind="stable")
            num = num[order]
            lo, hi = np.searchsorted(num, number), np.searchsorted(num, number, "right")
            run = order[spread(lo, hi - lo)]
            which = np.repeat(np.arange(len(number)), hi - lo)
            earlier = least[run] < block.doc_id[doc[which]]
            run, which = run[earlier], which[earlier]
            a = start[which] + begin[run]
            np.add.at(gone, a, 1)
            np.add.at(gone, a + length[run] + (kind.window - 1), -1)
        out = np.cumsum(gone[:n]) > 0
        # spans: maximal removed runs within a document
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        begins = out.copy()
        begins[1:] &= ~out[:-1] | edge[1:n]
        ends = out.copy()
        ends[:-1] &= ~out[1:] | edge[1:n]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        span_doc = np.searchsorted(b, first)
        local = np.searchsorted(first, b, "right") - 1
        removed = np.concatenate([[0], np.cumsum(out)])
        keep = ~out
        if kind.words:
            keep = np.repeat(keep, np.diff(block.offset))
            at = np.concatenate([[0], np.cumsum(keep)])[block.offset[first]]
        else:
            at = np.concatenate([[0], np.cumsum(keep)])[first]
        kept = block.data[keep]
        blank = int(kind.words)  # one blank stands behind each word; the last goes
        texts = [kept[i:max(i, j - blank)].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        spans = pa.ListArray.from_arrays(pa.array(span_doc, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(b - first[local]), pa.array(e - first[local])], ["begin", "end"]))
        ids = pa.array(block.doc_id, mask=block.doc_id == LAST)
        return pa.Table.from_arrays([ids, pa.array(block.h), pa.array(np.diff(first)), pa.array(removed[first[1:]] - removed[first[:-1]]),
                                     spans, pa.array(texts, pa.binary())], schema=RESULT)
    return apply


def remove_repeats(docs: DataFrame, kind: Kind, index: Callable, id_col: str, text_col: str,
                   block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Rows ``(doc_id, h, n_units, n_removed, spans, kept)``, one per row of ``docs``; ``h`` is
    Spark's ``xxhash64`` of the text (a null counts as empty).

    ``index(data, start, size, windows, ids)`` gets fragments as byte slices with
    their numbers of windows and document ids, and returns for every window
    (fragment by fragment) the smallest id of a fragment that contains it.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0  # one number
    blocks = int(total // block_bytes) + 1
    kind = replace(kind, bits=min(62, max(40, int(total).bit_length() + SPARE_BITS - 4)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"),
                       F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id",
                       F.xxhash64("text").alias("h"), "text").groupBy("block")
    keys = rows.applyInArrow(_send_keys(kind, blocks), "bucket int, block int, keys binary, contexts binary")
    shared = keys.groupBy("bucket").applyInArrow(_find_shared(hot), "block int, keys binary")
    asked = rows.cogroup(shared.groupBy("block")).applyInArrow(
        _send_fragments(kind, blocks), "bucket int, block int, number binary, size binary, part binary, windows binary, least binary, data binary")
    replies = asked.groupBy("bucket").applyInArrow(
        _answer(kind, index), "block int, number binary, begin binary, length binary, least binary")
    told = shared.unionByName(replies, allowMissingColumns=True)
    return rows.cogroup(told.groupBy("block")).applyInArrow(
        _apply(kind), "doc_id long, h long, n_units long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary")

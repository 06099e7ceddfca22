"""N-gram Jaccard join: which documents share at least 75 % of their word shingles.

A document's set holds its distinct five-word shingles. Sets are ordered
rare-first by the number of documents that have each shingle, and two sets that
are similar enough must share one of their first |x| - ceil(0.75 |x|) + 1 ones
(prefix filter). A shingle that no other document has can't be shared, so it only
counts; most documents have nothing else in their prefix and are done after the
counting. For the others:

1. Prefixes are exploded and joined on the shingle. A shingle's documents are
   split by set size into groups that the length filter lets meet.
2. Each group's members first meet one member, its hub (the one with the fewest
   shingles of its own): as many pairs as rows, however large a group of copies is.
3. Pairs pass the length filter, the positional filter and the suffix filter (the
   rest of both sets, cut into 32 ranges of the hash, bounds their distance from
   below) and each pair is verified once by the size of the intersection.
4. Links give components. Members of a group that now are in one component need no
   further pair. Those outside the group's largest component still meet all
   members of other components, with the positional filter, and new pairs are
   verified: so every link between two components is found, and no pairs within
   a group of copies are enumerated.

The result is components, not all links: a link inside a component that is not
one with a hub is never verified, and no links, link counts or pairs come out.

Equal texts enter as one document. Counting goes through compact sorted arrays of
shortened hashes: two shingles that meet by chance only look less rare than they are.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.hashing import U64, mix, slice_hashes, spread, word_table
from driftwatch.llm.repeats import BLOCK_BYTES, LAST, _pack, _split, _unpack
from driftwatch.session import checkpoint_dir, cut_lineage

SHINGLE, PERCENT = 5, 75
RANGES = 32
#: A shortened hash has so many bits more than the number of shingles takes.
SPARE_BITS = 6
TOP_COUNT = 65_535


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ngram-join-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Sets:
    """The shingle sets of a block's documents, each sorted by hash."""

    def __init__(self, table: pa.Table, skip: np.ndarray):
        key = table.column("k").to_numpy()
        key, first = np.unique(key, return_index=True)  # repeated rows count once
        use = ~np.isin(key, skip)
        self.key = key[use]
        text = table.column("text").take(pa.array(first[use])).to_pylist()
        where = np.zeros(len(text) + 1, np.int64)
        np.cumsum([len(t) for t in text], out=where[1:])
        data, offset, begin = word_table(np.frombuffer(b"".join(text), np.uint8), where, lower=True)
        words = slice_hashes(data, offset[:-1], np.diff(offset) - 1)
        n_words = np.diff(begin)
        count = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
        at = spread(begin[:-1], count)
        width = np.repeat(np.minimum(n_words, SHINGLE), count)
        h = width.astype(U64)
        padded = np.append(words, np.zeros(SHINGLE, U64))
        for i in range(SHINGLE):
            h *= U64(0xD1342543DE82EF95)
            h += np.where(i < width, padded[at + i], U64(0))
        h = mix(h)
        edge = np.concatenate([[0], np.cumsum(count)])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[edge[:-1][count > 0]] = True
        self.hash = h[new]
        self.first = np.concatenate([[0], np.cumsum(new)])[edge]

    def keys(self, bits: int):
        """(different shortened hashes, number of documents with each, place of each set's elements there)."""
        return np.unique(self.hash >> U64(64 - bits), return_inverse=True, return_counts=True)


def _skipped(told: pa.Table) -> np.ndarray:
    lists = [x.as_py() for x in told.column("skip") if x.is_valid] if told.num_rows else []
    return np.array([k for x in lists for k in x], np.int64)


def _send_keys(bits: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def send(key, docs, told):
        out = {f: [] for f in schema.names}
        if docs.num_rows:
            different, _, counts = Sets(docs, _skipped(told)).keys(bits)
            for bucket, i in _split(different, buckets):
                steps = np.diff(different[i], prepend=U64(0))
                for f, x in zip(schema.names, (bucket, key[0].as_py(), _pack(steps), _pack(np.minimum(counts[i], TOP_COUNT).astype("<u2")))):
                    out[f].append(x)
        return pa.Table.from_pydict(out, schema)
    return send


def _count(key, table):
    arrays = [np.cumsum(_unpack(x.as_py(), "<u8"), dtype=U64) for x in table.column("keys")]
    counts = np.concatenate([_unpack(x.as_py(), "<u2") for x in table.column("counts")]).astype(np.int64)
    _, place = np.unique(np.concatenate(arrays), return_inverse=True)
    total = np.minimum(np.bincount(place, counts).astype(np.int64), TOP_COUNT).astype("<u2")[place]
    cuts = np.cumsum([len(a) for a in arrays])[:-1]
    return pa.Table.from_pydict({"block": table.column("block"), "bucket": table.column("bucket"),
                                 "counts": [_pack(x) for x in np.split(total, cuts)]},
                                pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary())]))


def prefix_length(n):
    """How many rare-first elements two similar enough sets can't both do without."""
    return n - -(-PERCENT * n // 100) + 1


def _ordered(bits: int, buckets: int):
    schema = pa.schema([("k", pa.int64()), ("n", pa.int32()), ("alone", pa.int32()), ("shared", pa.list_(pa.int64()))])

    def order(key, docs, told):
        if not docs.num_rows:
            return schema.empty_table()
        sets = Sets(docs, _skipped(told))
        different, place, _ = sets.keys(bits)
        counts = np.ones(len(different), np.int64)
        replies = told.filter(pc.is_valid(told.column("counts")))
        answer = {b.as_py(): x for b, x in zip(replies.column("bucket"), replies.column("counts"))}
        for bucket, i in _split(different, buckets):
            counts[i] = _unpack(answer[bucket].as_py(), "<u2")
        counts = counts[place]
        alone, shared = [], []
        n = np.diff(sets.first)
        for a, b, size in zip(sets.first[:-1].tolist(), sets.first[1:].tolist(), n.tolist()):
            c = counts[a:b]
            several = c > 1
            m = size - int(several.sum())
            alone.append(m)
            if size and m < prefix_length(size):
                h, c = sets.hash[a:b][several], c[several]
                shared.append(h[np.lexsort((h, c))].view(np.int64))
            else:
                shared.append(None)  # nothing in the prefix that another document has
        return pa.Table.from_arrays([pa.array(sets.key), pa.array(n, pa.int32()), pa.array(alone, pa.int32()),
                                     pa.array(shared, pa.list_(pa.int64()))], schema=schema)
    return order


def _least_overlap(a: Column, b: Column) -> Column:
    """ceil(t / (1 + t) * (|x| + |y|)), the smallest intersection of a link."""
    return F.ceil(PERCENT * (a + b) / F.lit(100 + PERCENT))


def _length_fits(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, linked) of each pair, after the suffix filter."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(RANGES - 1)), lambda r: F.size(F.filter(
        "shared", lambda h: F.shiftrightunsigned(h, 64 - int(math.log2(RANGES))) == r)))
    brief = sets.select("k", "n", "alone", cut.alias("ranges"))
    side = lambda df, s: df.select(*[F.col(c).alias(s if c == "k" else c + s) for c in df.columns])
    near = pairs.join(side(brief, "x"), "x").join(side(brief, "y"), "y")
    apart = F.col("alonex") + F.col("aloney") + F.aggregate(
        F.zip_with("rangesx", "rangesy", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, d: s + d)
    near = near.where(apart <= F.col("nx") + F.col("ny") - 2 * _least_overlap(F.col("nx"), F.col("ny"))).select("x", "y")
    full = near.join(side(sets.select("k", "n", "shared"), "x"), "x").join(side(sets.select("k", "n", "shared"), "y"), "y")
    both = F.size(F.array_intersect("sharedx", "sharedy"))
    return full.where(100 * both >= PERCENT * (F.col("nx") + F.col("ny") - both)).select("x", "y")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(k, label): label is the least (doc_id, k) that links reach. Labels spread to
    neighbours and then to the label's own label, until none changes."""
    links = cut_lineage(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    labels = cut_lineage(nodes.select("k", F.struct("doc_id", "k").alias("label")))
    while True:
        near = links.join(labels.withColumnRenamed("k", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "k"), "k", "left").select(
            "k", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = step.select(F.col("k").alias("t"), F.col("label").alias("jump"))
        step = step.join(target, F.col("label.k") == F.col("t")).select("k", "old", F.least("label", "jump").alias("label"))
        step = cut_lineage(step)
        labels = step.select("k", "label")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def _links(sets: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links between different texts, labels of the sets)."""
    band = F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int")
    kept = F.col("n") - F.ceil(PERCENT * F.col("n") / F.lit(100)) + 1  # as prefix_length
    head = F.slice("shared", 1, F.greatest(kept.cast("int") - F.col("alone"), F.lit(1)))
    rows = sets.select("k", "n", "alone", band.alias("band"), F.posexplode(head).alias("i", "token"))
    # sizes of one band, or of two neighbouring bands, meet in one group
    rows = rows.select("k", "n", "alone", (F.col("alone") + F.col("i")).alias("i"), "token",
                       F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    rows = stored(rows.select(F.xxhash64("token", "band").alias("g"), "k", "n", "alone", "i"))
    # of many near copies, the one with the fewest shingles of its own is nearest to the others
    hub = rows.groupBy("g").agg(F.min(F.struct("alone", "k", "n")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    near = rows.join(hub, "g").where((F.col("k") != F.col("hub.k")) & _length_fits(F.col("n"), F.col("hub.n")))
    pairs = near.select(F.least("k", "hub.k").alias("x"), F.greatest("k", "hub.k").alias("y")).distinct()
    pairs = cut_lineage(pairs)
    links = cut_lineage(_verified(pairs, sets))
    nodes = ids.join(sets.select("k"), "k", "left_semi")
    labels = components(nodes, links)
    # members of a group that are not yet in one component
    placed = rows.join(labels.select("k", F.col("label.k").alias("c")), "k")
    sizes = placed.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"))
    split = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "c")).alias("top")).where("parts > 1")
    placed = stored(placed.join(split.select("g", F.col("top.c").alias("main")), "g"))
    other = placed.where("c != main").select(*[F.col(c).alias("o" + c) for c in ("g", "k", "n", "i", "c")])
    room = F.least(F.col("n") - F.col("i"), F.col("on") - F.col("oi"))  # positional filter at the first common element
    met = other.join(placed, F.col("og") == F.col("g")).where(
        (F.col("oc") != F.col("c")) & ((F.col("c") == F.col("main")) | (F.col("ok") < F.col("k")))
        & _length_fits(F.col("n"), F.col("on")) & (room >= _least_overlap(F.col("n"), F.col("on"))))
    more = met.select(F.least("k", "ok").alias("x"), F.greatest("k", "ok").alias("y")).distinct()
    found = cut_lineage(_verified(more.join(pairs, ["x", "y"], "left_anti"), sets))
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = components(nodes, links)
    return links, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id, k, stays)``, one per row of ``docs``; the
    component is the smallest id that links reach, the row's own included. ``k`` is Spark's
    ``xxhash64`` of (id, text) as they come in (nulls as the last id and the empty text);
    ``stays`` marks the first row of each component, and every row without words.

    A null, empty or blank text has an empty set and is linked with nothing; a text of under
    five words is one shingle; a null id stands behind all others (and comes back null);
    repeated rows and equal texts are one document with several rows; shingles are compared
    by 64-bit hashes; an empty table gives no rows; other columns are not looked at.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0  # one number
    blocks = int(total // block_bytes) + 1
    bits = min(62, max(32, int(total).bit_length() - 2 + SPARE_BITS))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("k", F.xxhash64("doc_id", "text"))
    block = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    ids = stored(base.select("doc_id", "k", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")))
    heads = ids.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "k")).alias("head"))
    members = stored(ids.join(heads, ["t1", "t2"]).select("doc_id", "k", F.col("head.k").alias("h")))
    skip = members.where("k != h").groupBy(block.alias("block")).agg(F.collect_set("k").alias("skip"))  # ids of one block
    texts = base.select(block.alias("block"), "k", F.encode("text", "UTF-8").alias("text")).groupBy("block")
    keys = texts.cogroup(skip.groupBy("block")).applyInArrow(_send_keys(bits, blocks), "bucket int, block int, keys binary, counts binary")
    counts = keys.groupBy("bucket").applyInArrow(_count, "block int, bucket int, counts binary")
    told = skip.unionByName(counts, allowMissingColumns=True)
    sets = stored(texts.cogroup(told.groupBy("block")).applyInArrow(
        _ordered(bits, blocks), "k long, n int, alone int, shared array<long>"))
    active = sets.where("shared is not null")
    links, labels = _links(active, ids.select("doc_id", "k").distinct())
    out = members.join(sets.select(F.col("k").alias("h"), "n"), "h", "left")
    out = out.join(labels.select(F.col("k").alias("h"), "label"), "h", "left")
    # a text without a label of its own still is one with its equal texts, unless it has no words
    first = members.groupBy("h").agg(F.min("doc_id").alias("least"))
    out = out.join(first, "h", "left")
    own = F.when(F.coalesce("n", F.lit(0)) > 0, F.coalesce("label.doc_id", "least")).otherwise(F.col("doc_id"))
    back = lambda c: F.when(c != LAST, c)
    return out.select(back(F.col("doc_id")).alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
                      back(own).alias("component_id"), "k",
                      ((F.coalesce("n", F.lit(0)) == 0) | (F.col("k") == F.coalesce("label.k", "h"))).alias("stays"))

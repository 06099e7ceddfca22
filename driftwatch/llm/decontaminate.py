"""Benchmark decontamination by word windows (DataFrame operations only).

The n-grams of every benchmark window (10 words, or the whole item if it has
fewer) go, hashed, into one table that is broadcast. A window of L words is
found by n-grams of g = ceil(L / 2) words: a document is probed at every
(L - g + 1)-th word only, because each window of L words holds exactly one
n-gram that begins at such a place and fits inside. A hit is then verified word for word
as a whole window. So each document is scanned once, with a probe for every
sixth word.

The table is counted first; beyond ``BROADCAST_WINDOWS`` windows (some 50 MB)
it is not broadcast: probes without texts are shuffled by their hash, and the
hits meet their documents again in a second join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import ascii_lower, row_key, words

#: Java class of what stands between normalised words (after lower-casing A-Z).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BROADCAST_WINDOWS = 50_000


def normal_words(c: Column) -> Column:
    return words(ascii_lower(F.coalesce(c, F.lit(""))), BETWEEN)


def gram_and_stride(length: int) -> tuple[int, int]:
    gram = (length + 1) // 2
    return gram, length - gram + 1


def _gram_hash(w: Column, at: Column, gram: int) -> Column:
    return F.xxhash64(F.lit(gram), *[F.get(w, at + k) for k in range(gram)])


def _probes(w: Column, length: int) -> Column:
    """(n, pos, h) of the n-grams of a document at every stride-th word."""
    gram, stride = gram_and_stride(length)
    last = F.size(w) - gram
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.struct(F.lit(length).alias("n"), p.alias("pos"), _gram_hash(w, p, gram).alias("h")))


def _seeds(bench: DataFrame, lengths: list[int]) -> DataFrame:
    """(_bh, _len, _o, _bw, _items): each window under the hash of each n-gram that a probe may meet in it."""
    def of(n: int) -> Column:
        gram, stride = gram_and_stride(n)
        return F.array(*[F.struct(F.lit(o).alias("o"), _gram_hash(F.col("_bw"), F.lit(o), gram).alias("h")) for o in range(stride)])

    each = F.lit(None)
    for n in lengths:
        each = F.when(F.col("_len") == n, of(n)).otherwise(each)
    return (bench.withColumn("_s", F.explode(each))
            .select(F.col("_s.h").alias("_bh"), "_len", F.col("_s.o").alias("_o"), "_bw", "_items"))


def windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(_h, _bw words, _len, _items) of each different window."""
    base = items.select(F.col(id_col).cast("string").alias("_item"), normal_words(F.col(text_col)).alias("_iw"))
    base = base.where((F.size("_iw") > 0) & F.col("_item").isNotNull()).withColumn("_len", F.least(F.size("_iw"), F.lit(window)))
    at = F.sequence(F.lit(1), F.size("_iw") - F.col("_len") + 1)
    each = base.select("_item", "_len", F.explode(F.transform(at, lambda i: F.slice("_iw", i, F.col("_len")))).alias("_bw"))
    return each.groupBy("_bw", "_len").agg(F.collect_set("_item").alias("_items"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text",
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Rows ``(id_col, n_words, n_hit, n_items, items_sha256, contaminated, _key)``, one per row of ``docs``.

    A null or empty text has no words and no hit; benchmark items without words
    (or without id) have no window; repeated rows get the same result each;
    an empty benchmark marks nothing, an empty table gives no rows.
    """
    bench = windows(benchmark, window, item_col, item_text)
    sizes = bench.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``window`` rows
    lengths = sorted(r["_len"] for r in sizes)
    small = sum(r["n"] for r in sizes) <= broadcast_windows
    base = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), normal_words(F.col(text_col)).alias("_w"))
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(None).cast("long").alias("h")))
    probe = base.withColumn("_p", F.explode(F.concat(none, *[_probes(F.col("_w"), n) for n in lengths])))
    probe = probe.select("_id", "_key", "_w", F.col("_p.n").alias("_n"), F.col("_p.pos").alias("_pos"), F.col("_p.h").alias("_h"))
    start = F.col("_pos") - F.col("_o")
    same = (start >= 0) & (F.slice("_w", F.greatest(start, F.lit(0)) + 1, F.greatest(F.col("_n"), F.lit(1))) == F.col("_bw"))
    found = ["_id", "_key", "_n", F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)).alias("_pos"), "_items",
             F.when(F.col("_n") == 0, F.size("_w")).alias("_size")]
    if small and lengths:
        seeds = F.broadcast(_seeds(bench, lengths))
        hit = probe.join(seeds, (probe["_h"] == seeds["_bh"]) & (probe["_n"] == seeds["_len"]), "left")
        hit = hit.where((F.col("_n") == 0) | same).select(*found)
    else:
        alone = base.withColumn("_n", F.lit(0)).withColumn("_pos", F.lit(0)).withColumn("_o", F.lit(0))
        hit = alone.withColumn("_items", F.lit(None).cast("array<string>")).select(*found)
        if lengths:
            seeds = _seeds(bench, lengths)
            bare = probe.where(F.col("_n") > 0).select("_key", "_n", "_pos", "_h")
            bare = bare.join(seeds, (bare["_h"] == seeds["_bh"]) & (bare["_n"] == seeds["_len"]))
            texts = base.dropDuplicates(["_key"])
            hit = hit.unionByName(bare.join(texts, "_key").where(same).select(*found))
    # one row per place (the longest window there) and one per document
    place = hit.groupBy("_key", "_pos", (F.col("_n") == 0).alias("_doc")).agg(
        F.first("_id").alias("_id"), F.max("_n").alias("_n"), F.max("_size").alias("_size"),
        F.count_if(F.col("_n") == 0).alias("_copies"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    before = Window.partitionBy("_key").orderBy("_pos", "_n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("_pos") + F.col("_n")
    new = F.greatest(end - F.greatest(F.col("_pos"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    docs_out = place.withColumn("_new", new).groupBy("_key").agg(
        F.first("_id").alias("_id"), F.max("_size").alias("n_words"), F.sum("_new").alias("n_hit"),
        F.max("_copies").alias("_copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    docs_out = docs_out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return docs_out.select(
        F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "_key")

"""Hard-negative mining with BOND, a branch-and-bound scan of vertical (columnar) vectors.

Scores are integer inner products. For each anchor the best same-label rows are
its positives; for each positive, the best other-label rows whose score lies in a
window below the positive's score are its hard negatives.

Rows are dealt to blocks that hold one array per dimension, anchors to groups. A
cell is one anchor group against one block; a task scans whole cells, so memory is
bounded by a block and a group, and each row meets each anchor in one cell only.
For an anchor the dimensions are read in descending order of the anchor's own
magnitudes. What the dimensions not read yet can add lies between two sums of
per-dimension minima and maxima over the block, so each candidate's score lies in
an interval; candidates whose interval misses every window still open, or lies
below the k best lower bounds of it, leave the candidate set. After the last
dimension the scores of those that are left are exact, and ties are resolved by id.

Two scans run: one over the same-label rows for the positives, one over the
other-label rows for the windows that the positives set. Each cell gives at most
k rows an anchor and window; Spark merges them by rank.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.session import cut_lineage, ship_package

BLOCK_ROWS = 8192
GROUP_ANCHORS = 4096
#: Dimensions read between two looks at the candidates.
STEP = 8
#: Tasks of one scan; beyond it a task gets several cells, one after the other.
MOST_TASKS = 20_000
#: Stands for a null id: behind all other ids.
LAST = (1 << 63) - 1
_EXACT = 1 << 53


class Columns:
    """Vectors as one array per dimension, with each dimension's least and greatest value."""

    def __init__(self, values: np.ndarray):
        self.values = values
        some = values.shape[1] > 0
        self.least = values.min(1) if some else np.zeros(len(values))
        self.most = values.max(1) if some else np.zeros(len(values))


def scan(anchor: np.ndarray, columns: Columns, candidates: np.ndarray | None, keep) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the candidates that ``keep(lower, upper)`` lets through to the end.

    ``candidates`` are places in the columns, None for all. ``keep`` may only drop a
    candidate whose score can't matter anywhere in [lower, upper]; it is asked after
    every ``STEP`` dimensions.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    q = anchor[order]
    a, b = q * columns.least[order], q * columns.most[order]
    rest_low = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0)
    rest_high = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0)
    every = columns.values.shape[1]
    alive = candidates
    score = np.zeros(every if alive is None else len(alive), columns.values.dtype)
    for at in range(0, len(q), STEP):
        if not len(score):
            break
        to = min(at + STEP, len(q))
        part = columns.values[order[at:to]]
        score = score + q[at:to] @ (part if alive is None else part[:, alive])
        good = keep(score + rest_low[to], score + rest_high[to])
        if not good.all():
            good = np.flatnonzero(good)
            score, alive = score[good], good if alive is None else alive[good]
    return (np.arange(every) if alive is None else alive), score


def best(k: int):
    """Keeps what may be among the k greatest scores, ties included."""
    def keep(lower, upper):
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]
    return keep


def windows(bounds: list[tuple[int, int]], k: int):
    """Keeps what may be among the k greatest scores of any window [least, most], ties included."""
    def keep(lower, upper):
        good = np.zeros(len(lower), bool)
        for least, most in bounds:
            may = (upper >= least) & (lower <= most)
            sure = lower[may & (lower >= least) & (upper <= most)]
            if len(sure) > k:
                may &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            good |= may
        return good
    return keep


def first(k: int, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the k greatest scores; ties go to the smaller id."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((row[at], ids[at], -score[at]))[:k]]


def bounds_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


class _Packed:
    def __init__(self, table: pa.Table, at: int, side: str):
        get = lambda name, kind: np.frombuffer(table.column(side + name)[at].as_py(), kind)
        self.row, self.ids, self.label = get("row", "<i8"), get("ids", "<i8"), get("label", "<i8")
        self.values = get("values", "<i4").reshape(-1, len(self.row))
        self.aim = get("aim", "<i8").reshape(len(self.row), -1)


def _kind(a: _Packed, b: _Packed):
    """float64 sums by BLAS are exact below 2^53; beyond, 64-bit integers are used."""
    most = lambda x: int(np.abs(x.values.astype(np.int64)).max(initial=0))
    return np.float64 if len(a.values) * most(a) * most(b) < _EXACT else np.int64


_OUT = pa.schema([("a_row", pa.int64()), ("aim", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


def _cell(k: int, low: int, high: int, same: bool):
    """Scans one cell: the k best same-label rows of each anchor, or the k best
    other-label rows of each of its windows."""
    def run(key, table):
        out = {name: [] for name in _OUT.names}
        for at in range(table.num_rows):
            a, b = _Packed(table, at, "a_"), _Packed(table, at, "b_")
            kind = _kind(a, b)
            whole = Columns(b.values.astype(kind))
            places = {x: np.flatnonzero(b.label == x) for x in np.unique(b.label).tolist()}
            own = {x: Columns(whole.values[:, i]) for x, i in places.items()} if same else {}
            others = {}
            anchors = np.ascontiguousarray(a.values.T).astype(kind)

            def put(n, aim, score, found):
                out["a_row"].append(np.full(len(found), a.row[n]))
                out["aim"].append(np.full(len(found), aim))
                out["score"].append(score.astype(np.int64))
                out["id"].append(b.ids[found])
                out["row"].append(b.row[found])

            for n, label in enumerate(a.label.tolist()):
                if same:
                    if label not in own:
                        continue
                    here = places[label]
                    other = np.flatnonzero(b.row[here] != a.row[n])
                    found, score = scan(anchors[n], own[label], other if len(other) < len(here) else None, best(k))
                    top = first(k, score, b.ids[here[found]], b.row[here[found]])
                    put(n, 0, score[top], here[found[top]])
                    continue
                aims = sorted(set(a.aim[n][a.aim[n] >= 0].tolist()))  # a negative score has an empty window
                if not aims:
                    continue
                if label not in others:
                    others[label] = np.flatnonzero(b.label != label) if label in places else None
                limits = [bounds_of(x, low, high) for x in aims]
                found, score = scan(anchors[n], whole, others[label], windows(limits, k))
                for aim, (least, most) in zip(aims, limits):
                    inside = np.flatnonzero((score >= least) & (score <= most))
                    top = inside[first(k, score[inside], b.ids[found[inside]], b.row[found[inside]])]
                    put(n, aim, score[top], found[top])
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out.values()], schema=_OUT)
    return run


def _blocks(rows: DataFrame, number: str, count: int, side: str) -> DataFrame:
    """One row per dimension count and block: its rows' numbers, ids, labels, columns and aims as arrays."""
    names = [side + x for x in ("row", "ids", "label", "values", "aim")]
    schema = pa.schema([("d", pa.int32()), (number, pa.int32()), *((x, pa.binary()) for x in names)])

    def pack(key, table):
        plain = [table.column(x).to_numpy().astype("<i8") for x in ("row", "id", "label")]
        flat = lambda x, kind: table.column(x).combine_chunks().flatten().to_numpy().astype(kind)
        d = key[0].as_py()
        values = flat("c", "<i4").reshape(table.num_rows, d).T if d else np.zeros((0, table.num_rows), "<i4")
        data = [*plain, np.ascontiguousarray(values), flat("aim", "<i8")]
        return pa.Table.from_arrays([pa.array([x.as_py()], f.type) for x, f in zip(key, schema)]
                                    + [pa.array([x.tobytes()], pa.binary()) for x in data], schema=schema)

    dealt = rows.withColumn(number, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    ddl = f"d int, {number} int, " + ", ".join(f"{x} binary" for x in names)
    return dealt.repartition(min(count, MOST_TASKS), "d", number).groupBy("d", number).applyInArrow(pack, ddl)


def _scanned(anchors: DataFrame, n_groups: int, blocks: DataFrame, n_blocks: int, run) -> DataFrame:
    """Every anchor group against every block of the same number of dimensions, cell by cell."""
    tasks = min(2 * n_groups * n_blocks, MOST_TASKS)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = anchors.select("*", every("j", n_blocks)).repartition(tasks, "d", "i", "j")
    right = blocks.select("*", every("i", n_groups)).repartition(tasks, "d", "i", "j")
    cells = left.join(right, ["d", "i", "j"])
    return cells.groupBy("d", "i", "j").applyInArrow(run, "a_row long, aim long, score long, id long, row long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key; Spark cuts each task's rows to k a key before they are dealt."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """Rows ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` says which rows are anchors; ``label_col`` is an integer column. A
    component x counts as floor(scale * x). Rows with a null label or vector, or any
    null or non-finite component, take no part; neither do rows with components so
    large that 100 scores of their length would not fit 64 bits (at 64 dimensions,
    beyond some 38 million after scaling). Vectors of different lengths have no
    score with each other; empty vectors score 0. A null id stands behind all others
    (and is no anchor unless ``anchor`` says so); repeated rows are rows like others,
    an anchor's own copies among its positives. An empty table, or one without
    anchors, gives no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(vector_col).cast("array<double>")
    fits = F.sqrt(F.lit(float((1 << 63) - 1) / 100) / F.greatest(F.size(v), F.lit(1))) - 1
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < fits))
    rows = vectors.where(F.col(label_col).isNotNull() & v.isNotNull() & sound).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"), F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("c"))
    rows = cut_lineage(rows.withColumn("d", F.size("c")).withColumn("row", F.monotonically_increasing_id()))
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    n_blocks, n_groups = math.ceil(n_rows / block_rows) or 1, math.ceil(n_anchors / group_anchors) or 1
    none = F.array().cast("array<bigint>")
    blocks = cut_lineage(_blocks(rows.withColumn("aim", none), "j", n_blocks, "b_"))
    anchors = rows.where("is_anchor")

    near = _scanned(_blocks(anchors.withColumn("aim", none), "i", n_groups, "a_"), n_groups, blocks, n_blocks,
                    _cell(positives, low, high, same=True))
    near = cut_lineage(_ranked(near, ["a_row"], positives).select("a_row", F.col("id").alias("positive_id"), F.col("score").alias("aim")))

    aims = near.groupBy("a_row").agg(F.collect_list("aim").alias("aim"))  # at most ``positives`` each
    full = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda n: F.coalesce(F.get("aim", n - 1), F.lit(-1).cast("long")))
    aimed = anchors.join(aims, anchors["row"] == aims["a_row"]).withColumn("aim", full).drop("a_row")
    far = _scanned(_blocks(aimed, "i", n_groups, "a_"), n_groups, blocks, n_blocks, _cell(negatives, low, high, same=False))
    far = _ranked(far, ["a_row", "aim"], negatives)
    ids = anchors.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id"))
    known = lambda name: F.nullif(F.col(name), F.lit(LAST)).alias(name)
    return far.withColumnRenamed("id", "negative_id").join(near, ["a_row", "aim"]).join(ids, "a_row").select(
        known("anchor_id"), known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"),
        F.col("aim").alias("positive_score"), F.col("score").alias("negative_score"))

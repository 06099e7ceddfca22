import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, d string, c string, score string"


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    last = math.inf
    sound = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows
             if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    key = lambda x: (-x[0], last if x[1] is None else x[1])
    for at, (i, v, y) in enumerate(sound):
        if not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for n, (j, w, z) in enumerate(sound) if n != at and len(w) == len(v)]
        for ps, p, _ in sorted((x for x in scored if x[2] == y), key=key)[:positives]:
            inside = [x for x in scored if x[2] != y and low * ps <= 100 * x[0] <= high * ps]
            for rank, (ns, n, _) in enumerate(sorted(inside, key=key)[:negatives], 1):
                out[i, p, rank, n, ps, ns] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    heart = rng.normal(size=12)
    near = lambda: np.float32(heart + 0.4 * rng.normal(size=12)).tolist()
    common = near()
    out = [(i, near(), int(rng.integers(0, 4))) for i in range(160)]
    out += [(200 + i, common, i % 3) for i in range(60)]  # one vector in many rows: ties
    out += [(300, [float("nan")] + near()[1:], 1), (301, [None] + near()[1:], 1), (302, None, 1), (303, near(), None),
            (304, [float("inf")] + near()[1:], 1), (305, [0.0] * 12, 2), (306, (-np.array(common)).tolist(), 0),
            (307, near()[:5], 1), (308, near()[:5], 1), (309, near()[:5], 0), (310, [], 0), (320, [], 0), (311, [], 1)]
    out += [out[10], out[10], (None, near(), 1), (None, common, 2)]  # repeated rows, null ids
    random.Random(3).shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block, group, low", [(8192, 4096, 80), (16, 5, 95)])
def test_equals_brute_force(spark, rows, block, group, low):
    out = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, low=low, block_rows=block, group_anchors=group)
    assert Counter(tuple(r) for r in out.collect()) == brute(rows, lambda i: i is not None and i % 10 == 0, low=low)


def test_wide_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(1 << 16, 1 << 17, 6).astype(float).tolist(), i % 2) for i in range(40)]  # sums beyond 2^53
    out = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 4 == 0, block_rows=16)
    assert Counter(tuple(r) for r in out.collect()) == brute(rows, lambda i: i % 4 == 0)


def test_nothing_to_mine(spark, rows):
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, rows), F.lit(False)).count() == 0
    assert hard_negatives.mine(frame(spark, [(0, [1.0], 1)]), F.col("vec_id") == 0).count() == 0


def test_scan_drops_candidates_before_the_last_dimension():
    rng = np.random.default_rng(7)
    weight = np.geomspace(200, 1, 64)
    columns = hard_negatives.Columns(np.rint(rng.normal(size=(64, 4000)) * weight[:, None]))
    anchor, seen = np.rint(rng.normal(size=64) * weight), []
    keep = hard_negatives.best(5)
    found, score = hard_negatives.scan(anchor, columns, None, lambda a, b: (seen.append(len(a)), keep(a, b))[1])
    want = anchor @ columns.values
    assert sorted(want)[-5:] == sorted(score)[-5:] and (want[found] == score).all()
    assert seen[0] == 4000 and seen[-1] < 400 and seen == sorted(seen, reverse=True)

"""Distributed helpers: exact quantile, consecutive ids, running sums, loaders."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.functions.cumulative import global_running_sum
from driftwatch.functions.ids import consecutive_index
from driftwatch.functions.quantile import exact_quantile, exact_quantiles
from driftwatch.operators.features import stratified_split
from driftwatch.sources import loaders as LD


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.85, 0.95, 1.0])
def test_exact_quantile_matches_numpy(spark, p):
    rnd = random.Random(3)
    vals = [rnd.choice([rnd.random() * 100, 7.0, 7.0, 42.5]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantile(df, "x", p, accuracy=1000).first()["q"]
    assert got == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.2, 0.5, 1.0])
def test_exact_quantiles_of_many_columns(spark, p):
    rnd = random.Random(4)
    cols = [f"c{i}" for i in range(24)]
    rows = [tuple(rnd.choice([None, float(rnd.randrange(5)), rnd.random() * 10 ** (i % 7), -3.5]) for i in range(22)) + (None, 8.25)
            for _ in range(900)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = exact_quantiles(df, cols, p, accuracy=500).first()
    for i, c in enumerate(cols):
        values = [r[i] for r in rows if r[i] is not None]
        want = float(np.quantile(values, p)) if values else None
        assert got[c] == (pytest.approx(want, rel=1e-12, abs=1e-12) if values else None)
    assert exact_quantiles(df.limit(0), cols[:2], p).first()["c0"] is None


def test_stratified_split_is_exact_per_class(spark):
    import hashlib
    rows = [(i, "x" if i % 11 == 0 else "y" if i % 2 else None) for i in range(1003)]
    df = spark.createDataFrame(rows, "customer_id long, cls string").repartition(6)
    for share in (0.2, 0.0, 1.0, 0.37):
        out = stratified_split(df, "cls", share).collect()
        assert len(out) == len(rows)
        want = set()
        for c in ("x", "y", None):
            ids = sorted((int(hashlib.md5(f"{i}|42".encode()).hexdigest()[:15], 16), i) for i, k in rows if k == c)
            want.update(i for _, i in ids[:int(share * len(ids))])
        assert {r["customer_id"] for r in out if r["is_test"]} == want


def test_consecutive_index_after_shuffle(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    idx = consecutive_index(df, ["k"], "i")
    rows = idx.collect()
    assert len(rows) == 5000
    assert sorted(r["i"] for r in rows) == list(range(5000))
    assert all(r["i"] == r["k"] for r in rows)


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1, 301)], "s long, v long").repartition(5)
    r = {row["s"]: row["cum_v"] for row in global_running_sum(df, [F.col("s").desc()], ["v"]).collect()}
    exp, acc = {}, 0
    for s in range(300, 0, -1):
        acc += s % 3
        exp[s] = acc
    assert r == exp


def test_paysim_loader(spark):
    raw = spark.createDataFrame(
        [(1, "CASH_IN", 10.0, "C1", "M1", 0), (30, "TRANSFER", 20.0, "C1", "M2", 1),
         (49, "WEIRD", 5.0, "C2", "M1", 0)],
        "step long, type string, amount double, nameOrig string, nameDest string, isFraud int")
    tx, fraud = LD.load_paysim(raw)
    got = {r["amount"]: (r["transaction_type"], r["method"], str(r["transaction_date"])[:10]) for r in tx.collect()}
    assert got[10.0] == ("deposit", "cash", "2025-01-01")
    assert got[20.0] == ("withdrawal", "wire", "2025-01-02")
    assert got[5.0] == ("withdrawal", "ach", "2025-01-03")
    assert [r["customer_id"] for r in fraud.collect()] == ["C1"]


def test_counterparty_pool(spark):
    df = spark.createDataFrame([(i, f"d{i % 7}") for i in range(20)], "transaction_id long, counterparty string")
    out = {r["transaction_id"]: r["counterparty"] for r in LD.remap_counterparty_pool(df, pool=3).collect()}
    # first-seen order d0..d6 -> CP000, CP001, CP002, CP000, ...
    assert out[0] == "CP000" and out[1] == "CP001" and out[2] == "CP002" and out[3] == "CP000"
    assert out[7] == out[0]

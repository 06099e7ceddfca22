"""Registered queries against their DuckDB oracles on the smallest data."""
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from driftwatch.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
FAST = ["b01_entropy", "b04_entropies", "b06_entropy_drift_events", "b07_temporal_burst",
        "b08_counterparty_expansion_events", "b13_amount_anomaly", "b14_all_signals",
        "g01_build_edges", "g03_degrees_flows", "g04_circular_flows_len3", "g05_layer_depth",
        "g06_flow_velocity", "g19_top_counterparties", "f01_traditional_features",
        "i03_bsi_rescaled", "l02_link_fiat_to_crypto", "l06_flow_summary", "r03_rate_as_of",
        "a01_create_alerts", "a08_breakdown", "e04_auc_roc", "e06_best_threshold"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", FAST)
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "benford_deviation" in df.columns

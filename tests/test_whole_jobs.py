"""Queries over the whole table where an earlier one covers a part of it."""
import duckdb
import pytest

import __spark_entry__ as E
from driftwatch.sources.tables import DRIVER_TABLES
from tests.test_oracles import _digest

SF = "/root/testdata/sf0.01"  # more customers than the sample of S07


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _compare(spark, con, key):
    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    cols, want = [d[0] for d in res.description], res.fetchall()
    assert _digest(df.columns, rows) == _digest(cols, want)
    return rows


def test_customer_dimension_of_all(spark, con):
    rows = _compare(spark, con, "s08_customer_dimension_all")
    n = con.execute("SELECT count(*) FROM customer").fetchone()[0]
    assert len(rows) == len({r[0] for r in rows}) == n


@pytest.mark.parametrize("key", ["g02_nodes_all", "g03_degrees_flows_all", "g14_structural_risk_all"])
def test_account_graph_of_all_lines(spark, con, key):
    assert len(_compare(spark, con, key)) == con.execute("SELECT count(*) FROM customer").fetchone()[0]


def test_all_lines_reach_the_loader_and_pagerank(spark, con):
    lines = con.execute("SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchone()[0]
    assert E.queries()["s02_load_account_edges"](spark, SF).count() == lines
    ids = con.execute("SELECT count(*) FROM customer").fetchone()[0]
    assert E.queries()["g07_pagerank"](spark, SF).count() == ids

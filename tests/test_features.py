"""F01 counts different values and short gaps without dealing the rows once per column."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from driftwatch.operators import features as FT


def test_distinct_values_count_no_nulls(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "b", None), (2, None, None), (3, None, "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "customer_id long, counterparty string, location string")
    got = {tuple(r) for r in FT.distinct_values(df, {"counterparty": "c", "location": "l"}).collect()}
    assert got == {(1, 2, 2), (3, 1, 1)}  # 2 has no value at all
    want = df.groupBy("customer_id").agg(F.count_distinct("counterparty").alias("c"), F.count_distinct("location").alias("l"))
    assert got == {tuple(r) for r in want.collect() if r["c"] or r["l"]}


def test_features_expand_no_aggregates_and_window_no_rows(spark):
    df = E.queries()["f01_traditional_features"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # several count_distinct beside other aggregates
    rapid = FT.rapid_sequence(spark.createDataFrame([(1, 0)], "customer_id long, ts_us long"))
    assert "Join" not in rapid._jdf.queryExecution().optimizedPlan().toString()

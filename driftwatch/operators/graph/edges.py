"""Edge and node tables of the customer → counterparty graph.

Every edge is customer → counterparty whatever the money direction (as in the
reference).  Node ids are strings.  Edges carry weight (sum of amounts),
count and first/last time (epoch µs); the per-edge list of dates is not materialised,
since one edge may hold an unbounded number of rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVALID_COUNTERPARTIES = ["", "None", "nan"]


def valid_edge_rows(txns: DataFrame) -> DataFrame:
    """Rows whose counterparty is a usable node id; adds ``src``/``dst``."""
    return (txns.filter(F.col("counterparty").isNotNull()
                        & ~F.col("counterparty").isin(*INVALID_COUNTERPARTIES))
            .withColumn("src", F.col("customer_id").cast("string"))
            .withColumn("dst", F.col("counterparty")))


def build_edges(txns: DataFrame) -> DataFrame:
    """``edges(src, dst, weight, count, first_us, last_us)``; one
    partial+final hash aggregate on (src, dst)."""
    return (valid_edge_rows(txns).groupBy("src", "dst")
            .agg(F.sum("amount").alias("weight"), F.count("*").alias("count"),
                 F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")))


def build_nodes(edges: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """``nodes(id, node_type)``; customer wins over counterparty.
    With ``customers`` given, isolated customers are added (G02)."""
    ends = (edges.select(F.col("src").alias("id"), F.lit(2).alias("_t"))
            .unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("_t"))))
    if customers is not None:
        ends = ends.unionByName(customers.select(F.col("customer_id").cast("string").alias("id"),
                                                 F.lit(2).alias("_t")))
    return (ends.groupBy("id").agg(F.max("_t").alias("_t"))
            .select("id", F.when(F.col("_t") == 2, "customer").otherwise("counterparty").alias("node_type")))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct node ids of an edge table."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()

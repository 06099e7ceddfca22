"""Temporal graph snapshots and per-node dynamics.

Windows are anchored at the global last time and half-open
``[max − (i+1)·w, max − i·w)``, i = periods−1 … 0 (rows at the max are out).
Per window: distinct edges, degree (edges touching the node; a self-loop
counts twice), and edges new against the previous window only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.exprs import attach_scalars

from driftwatch.functions import dims
from driftwatch.functions.exprs import US_PER_DAY
from driftwatch.operators.graph.edges import valid_edge_rows

K = "customer_id"
TEMPORAL_COLS = ["new_counterparties_last_window", "avg_new_counterparties_per_window",
                 "max_degree_change", "degree_trend_slope", "hub_emergence_speed", "edge_volatility"]


def temporal_snapshots(txns: DataFrame, window_days: int = dims.GRAPH_TEMPORAL_WINDOW_DAYS,
                       periods: int = dims.GRAPH_TEMPORAL_PERIODS) -> DataFrame:
    """Sparse ``(id, period, degree, new_edges)``, period 0 = oldest."""
    w_us = window_days * US_PER_DAY
    v = valid_edge_rows(txns).select("src", "dst", "ts_us")
    mx = v.agg(F.max("ts_us").alias("_mx"))  # one row
    d = attach_scalars(v, mx)
    i = (F.ceil((F.col("_mx") - F.col("ts_us")) / F.lit(w_us)) - 1).cast("int")
    e = (d.filter(F.col("ts_us") < F.col("_mx"))
         .select("src", "dst", (F.lit(periods - 1) - i).alias("period"))
         .filter((F.col("period") >= 0) & (F.col("period") < periods))
         .distinct())
    prev = e.select("src", "dst", (F.col("period") + 1).alias("period"))
    new = e.join(prev, ["src", "dst", "period"], "left_anti")
    ends = (e.select(F.col("src").alias("id"), "period", F.lit(1).alias("deg"), F.lit(0).alias("new"))
            .unionByName(e.select(F.col("dst").alias("id"), "period", F.lit(1).alias("deg"), F.lit(0).alias("new")))
            .unionByName(new.select(F.col("src").alias("id"), "period", F.lit(0).alias("deg"), F.lit(1).alias("new")))
            .unionByName(new.select(F.col("dst").alias("id"), "period", F.lit(0).alias("deg"), F.lit(1).alias("new"))))
    return ends.groupBy("id", "period").agg(F.sum("deg").cast("long").alias("degree"),
                                            F.sum("new").cast("long").alias("new_edges"))


def dense_snapshots(snap: DataFrame, nodes: DataFrame, periods: int = dims.GRAPH_TEMPORAL_PERIODS) -> DataFrame:
    """G15 dense form: every node × every period, zeros filled."""
    grid = nodes.select("id").distinct().crossJoin(
        nodes.sparkSession.range(periods).select(F.col("id").cast("int").alias("period")).hint("broadcast"))
    return grid.join(snap, ["id", "period"], "left").fillna({"degree": 0, "new_edges": 0})


def temporal_signals_from(snap: DataFrame, periods: int = dims.GRAPH_TEMPORAL_PERIODS) -> DataFrame:
    """G16 per node from its (≤ periods) snapshot rows: pivot to fixed columns,
    then closed forms (slope, population std) and the hub-emergence scan as
    one generated CASE expression."""
    ps = list(range(periods))
    p = (snap.groupBy("id").pivot("period", ps)
         .agg(F.first("degree").alias("d"), F.first("new_edges").alias("n")))
    dcol = [F.coalesce(F.col(f"{i}_d"), F.lit(0)).cast("double") for i in ps]
    ncol = [F.coalesce(F.col(f"{i}_n"), F.lit(0)).cast("double") for i in ps]
    xbar = (periods - 1) / 2
    sxx = sum((i - xbar) ** 2 for i in ps)
    slope = sum(((i - xbar) / sxx) * dcol[i] for i in ps) if periods >= 2 else F.lit(0.0)
    max_change = F.greatest(*[dcol[i] - dcol[i - 1] for i in ps[1:]]) if periods >= 3 else (
        dcol[1] - dcol[0] if periods == 2 else F.lit(0.0))
    mean_n = sum(ncol) / periods
    std_n = F.sqrt(sum((c - mean_n) * (c - mean_n) for c in ncol) / periods)
    lo, hi = dims.GRAPH_HUB_LOW, dims.GRAPH_HUB_DEGREE
    hub = None
    for i in ps[1:]:
        below_any = None
        last_below = None
        for j in reversed(range(i)):
            cond = dcol[j] <= lo
            below_any = cond if below_any is None else (below_any | cond)
            last_below = F.when(cond, F.lit(i - j)) if last_below is None else last_below.when(cond, F.lit(i - j))
        c = (dcol[i] >= hi) & below_any
        hub = F.when(c, last_below) if hub is None else hub.when(c, last_below)
    hub = hub.otherwise(F.lit(0)) if hub is not None else F.lit(0)
    active = F.greatest(*dcol) > 0 if periods > 1 else dcol[0] > 0
    z = lambda x, zero: F.when(active, x).otherwise(F.lit(zero))
    return p.select(
        "id",
        z(ncol[-1], 0.0).cast("long").alias("new_counterparties_last_window"),
        z(mean_n, 0.0).alias("avg_new_counterparties_per_window"),
        z(max_change, 0.0).cast("long").alias("max_degree_change"),
        z(slope, 0.0).alias("degree_trend_slope"),
        z(hub, 0).cast("long").alias("hub_emergence_speed"),
        z(std_n if periods > 1 else F.lit(0.0), 0.0).alias("edge_volatility"),
    )


def temporal_signals(txns: DataFrame, edges: DataFrame | None, customers: DataFrame,
                     window_days: int = dims.GRAPH_TEMPORAL_WINDOW_DAYS,
                     periods: int = dims.GRAPH_TEMPORAL_PERIODS) -> DataFrame:
    """G16 per customer (zeros for customers without activity)."""
    sig = temporal_signals_from(temporal_snapshots(txns, window_days, periods), periods)
    c = customers.select(K, F.col(K).cast("string").alias("id"))
    j = c.join(sig, "id", "left")
    return j.select(K, *[F.coalesce(F.col(x), F.lit(0)).alias(x) if x in ("new_counterparties_last_window",
                                                                         "max_degree_change", "hub_emergence_speed")
                         else F.coalesce(F.col(x), F.lit(0.0)).alias(x) for x in TEMPORAL_COLS])

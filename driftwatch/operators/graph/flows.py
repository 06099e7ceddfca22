"""Degrees and flows, flow velocity, structural risk,
top counterparties."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions import dims
from driftwatch.functions.exprs import US_PER_HOUR
from driftwatch.operators.sequence import next_event_after

K = "customer_id"


def degrees(edges: DataFrame) -> DataFrame:
    """In/out degree and weight per node (edges are distinct (src, dst))."""
    out_ = edges.groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("out_degree"), F.sum("weight").alias("total_outflow"))
    in_ = edges.groupBy(F.col("dst").alias("id")).agg(
        F.count("*").alias("in_degree"), F.sum("weight").alias("total_inflow"))
    d = out_.join(in_, "id", "full")
    return d.select("id",
                    F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"),
                    F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"),
                    F.coalesce("total_inflow", F.lit(0.0)).alias("total_inflow"),
                    F.coalesce("total_outflow", F.lit(0.0)).alias("total_outflow"))


def funnel_rule(in_d, out_d) -> F.Column:
    return ((in_d >= 4) & (out_d <= 2)) | ((out_d >= 4) & (in_d <= 2))


def degrees_flows(edges: DataFrame, customers: DataFrame) -> DataFrame:
    """G03 per customer: degrees, flows, funnel ratio max/(min+1), funnel flag;
    a customer absent from the graph gets zeros and false."""
    d = degrees(edges)
    c = customers.select(K, F.col(K).cast("string").alias("id"))
    j = c.join(d, "id", "left")
    in_d, out_d = F.col("in_degree"), F.col("out_degree")
    present = in_d.isNotNull()
    return j.select(
        K,
        F.coalesce(funnel_rule(in_d, out_d), F.lit(False)).alias("is_funnel_hub"),
        F.coalesce(in_d, F.lit(0)).alias("in_degree"),
        F.coalesce(out_d, F.lit(0)).alias("out_degree"),
        F.when(present, F.greatest(in_d, out_d) / (F.least(in_d, out_d) + 1)).otherwise(F.lit(0.0)).alias("funnel_ratio"),
        F.coalesce("total_inflow", F.lit(0.0)).alias("total_inflow"),
        F.coalesce("total_outflow", F.lit(0.0)).alias("total_outflow"),
    )


def structurally_risky(edges: DataFrame) -> DataFrame:
    """G14 per node: funnel rule or total degree >= 12."""
    d = degrees(edges)
    return d.select("id", (funnel_rule(F.col("in_degree"), F.col("out_degree"))
                           | (F.col("in_degree") + F.col("out_degree") >= 12)).alias("is_risky"))


def flow_velocity(txns: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """For each deposit the first strictly later withdrawal of the same
    customer (unbounded look-ahead, skew-safe kernel); mean retention hours,
    count under 72 h, velocity 1/(mean+1).  Defaults 0 / 999999 / 0."""
    t = txns.select(K, "ts_us", "transaction_type")
    dep = t.filter(F.col("transaction_type") == "deposit").select(K, "ts_us")
    wd = t.filter(F.col("transaction_type") == "withdrawal").select(K, "ts_us")
    m = next_event_after(wd, dep, K)
    hours = (F.col("next_us") - F.col("ts_us")) / F.lit(float(US_PER_HOUR))
    agg = (m.filter(F.col("next_us").isNotNull())
           .groupBy(K).agg(F.avg(hours).alias("_avg"),
                           F.count(F.when(hours < dims.GRAPH_RAPID_PASSTHROUGH_HOURS, 1)).alias("_rapid")))
    base = (customers.select(K) if customers is not None else t.select(K).distinct())
    n = t.groupBy(K).agg(F.count("*").alias("_n"))
    j = base.join(n, K, "left").join(agg, K, "left")
    ok = (F.col("_n") >= 2) & F.col("_avg").isNotNull()
    return j.select(
        K,
        F.when(ok, 1.0 / (F.col("_avg") + 1.0)).otherwise(F.lit(0.0)).alias("flow_velocity"),
        F.when(ok, F.col("_avg")).otherwise(F.lit(999999.0)).alias("avg_retention_hours"),
        F.when(ok, F.col("_rapid")).otherwise(F.lit(0)).cast("long").alias("rapid_passthrough_count"),
    )


def top_counterparties(txns: DataFrame, top_n: int = 30) -> DataFrame:
    """Per customer and counterparty (20-char name): inflow (deposits),
    outflow (withdrawals), count, first country and method (earliest row),
    top ``top_n`` by volume.  The per-group limit is planned as a partial
    window group limit before the shuffle."""
    v = txns.filter(F.col("counterparty").isNotNull() & (F.col("counterparty") != ""))
    g = v.groupBy(K, F.substring("counterparty", 1, 20).alias("counterparty")).agg(
        F.sum(F.when(F.col("transaction_type") == "deposit", F.col("amount")).otherwise(0.0)).alias("inflow"),
        F.sum(F.when(F.col("transaction_type") != "deposit", F.col("amount")).otherwise(0.0)).alias("outflow"),
        F.count("*").alias("txn_count"),
        F.min_by("country", F.struct("ts_us", "transaction_id")).alias("country"),
        F.min_by("method", F.struct("ts_us", "transaction_id")).alias("method"),
    ).withColumn("volume", F.col("inflow") + F.col("outflow"))
    w = Window.partitionBy(K).orderBy(F.col("volume").desc(), F.col("counterparty"))
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)

"""One registered key per §2 operator that the combined queries already
compute (B02, B03, B05, B09–B12, I01, L03, L09, R04, R05, G11, S01, S10):
each is a projection of its operator, and its oracle wraps the validated
oracle text of the combined query."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions.exprs import normalize
from driftwatch.operators import linkage as L
from driftwatch.operators import rates as R
from driftwatch.operators import signals as S
from driftwatch.operators.graph import community as GM
from driftwatch.plans import q_alerts, q_link, q_signals
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.q_graph import account_communities
from driftwatch.plans.stages import stage
from driftwatch.plans.stages import view as V
from driftwatch.sources import tables as TB


def _wrap(key: str, cols: str, mod) -> str:
    return f"SELECT {cols} FROM ({mod.ORACLES[key]}) q"


def q_b02_amount_entropy(spark, sf):
    prep(spark)
    return rounded(S.grouped_entropies(V(spark, sf, "tx_events"), ["customer_id"]).select("customer_id", "amount_entropy"))


def q_b03_timing_entropy(spark, sf):
    prep(spark)
    return rounded(S.grouped_entropies(V(spark, sf, "tx_events"), ["customer_id"]).select("customer_id", "timing_entropy"))


def q_b05_tumbling_windows(spark, sf):
    """Complete tumbling windows per customer (index -1 = short history)."""
    prep(spark)
    w = S.tumbling_window_index(V(spark, sf, "tx_events"), 3).filter(F.col("win").isNotNull())
    return w.groupBy("customer_id", "win").agg(F.count("*").alias("rows"))


def _amount(spark, sf):
    return rounded(S.amount_anomaly(V(spark, sf, "tx_orders")))


def q_b09_benford_deviation(spark, sf):
    prep(spark)
    return _amount(spark, sf).select("customer_id", "benford_deviation")


def q_b10_structuring_score(spark, sf):
    prep(spark)
    return _amount(spark, sf).select("customer_id", "structuring_score")


def q_b11_round_amount_ratio(spark, sf):
    prep(spark)
    return _amount(spark, sf).select("customer_id", "round_amount_ratio")


def q_b12_skew_kurtosis(spark, sf):
    prep(spark)
    return _amount(spark, sf).select("customer_id", "amount_skewness", "amount_kurtosis")


def q_i01_normalize(spark, sf):
    """I01 on a signal: clip((burstiness − 0)/(1 − 0)) and a degenerate range (0.5)."""
    prep(spark)
    b = S.temporal_burst(V(spark, sf, "tx_events"))
    return rounded(b.select("customer_id", normalize("burstiness_index", 0, 1.0).alias("burst_norm"),
                            normalize("burst_events", 0, 30).alias("events_norm"),
                            normalize("burst_events", 5, 5).alias("degenerate")))


def q_l03_link_tiers(spark, sf):
    prep(spark)
    return L.link_fiat_to_crypto(V(spark, sf, "tx_orders")).groupBy("confidence").agg(F.count("*").alias("links"))


def q_l09_wallet_seen(spark, sf):
    prep(spark)
    ch = TB.chain_hops(spark, sf, V(spark, sf, "tx_orders"))
    return L.wallet_totals(ch, L.wallets_fixture(ch)).select("wallet_id", "first_seen_us", "last_seen_us")


def q_r04_to_usd(spark, sf):
    prep(spark)
    t = V(spark, sf, "tx_orders").select("transaction_id", "amount", "usd_rate")
    return rounded(t.select("transaction_id", R.to_usd(F.col("amount"), F.col("usd_rate")).alias("usd")))


def q_r05_usd_amount(spark, sf):
    prep(spark)
    t = V(spark, sf, "tx_orders")
    return rounded(t.groupBy("customer_id").agg(
        F.sum(F.col("amount") * F.coalesce(F.col("usd_rate"), F.lit(1.0))).alias("usd_total")))


def q_g11_community_sizes(spark, sf):
    prep(spark)
    lab = account_communities(spark, sf)
    return lab.groupBy("community").agg(F.count("*").alias("size"))


def q_s01_read_tables(spark, sf):
    prep(spark)
    out = None
    for t in TB.DRIVER_TABLES:
        c = TB.read_table(spark, sf, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def q_s10_stage_outputs(spark, sf):
    """Stage tables written partitioned by run date and read back."""
    import hashlib
    from driftwatch.session import checkpoint_dir
    from driftwatch.sources.loaders import write_stage_outputs
    prep(spark)
    base = (f"{checkpoint_dir(spark).rstrip('/')}/outputs/{spark.sparkContext.applicationId}/"
            f"{hashlib.md5(sf.encode()).hexdigest()[:12]}")
    outs = {"alerts": q_alerts._alerts(spark, sf).drop("alert_date"),
            "links": L.link_fiat_to_crypto(V(spark, sf, "tx_orders"))}
    write_stage_outputs(outs, base, "2025-12-31")
    return spark.read.parquet(f"{base}/alerts").groupBy("run_date").agg(F.count("*").alias("rows"))


QUERIES = {
    "b02_amount_entropy": q_b02_amount_entropy,
    "b03_timing_entropy": q_b03_timing_entropy,
    "b05_tumbling_windows": q_b05_tumbling_windows,
    "b09_benford_deviation": q_b09_benford_deviation,
    "b10_structuring_score": q_b10_structuring_score,
    "b11_round_amount_ratio": q_b11_round_amount_ratio,
    "b12_skew_kurtosis": q_b12_skew_kurtosis,
    "i01_normalize": q_i01_normalize,
    "l03_link_tiers": q_l03_link_tiers,
    "l09_wallet_seen": q_l09_wallet_seen,
    "r04_to_usd": q_r04_to_usd,
    "r05_usd_amount": q_r05_usd_amount,
    "g11_community_sizes": q_g11_community_sizes,
    "s01_read_tables": q_s01_read_tables,
    "s10_stage_outputs": q_s10_stage_outputs,
}

DAY = 86400000000
ORACLES = {
    "b02_amount_entropy": _wrap("b04_entropies", "customer_id, amount_entropy", q_signals),
    "b03_timing_entropy": _wrap("b04_entropies", "customer_id, timing_entropy", q_signals),
    "b05_tumbling_windows": with_views(f""",
sp AS (SELECT customer_id, min(ts_us) AS mn, max(ts_us) AS mx FROM tx_events GROUP BY 1),
w AS (SELECT t.customer_id, CASE WHEN floor((mx - mn) / {DAY}) < 6 THEN -1
             WHEN mn + (floor((ts_us - mn) / {3 * DAY}) + 1) * {3 * DAY} <= mx THEN floor((ts_us - mn) / {3 * DAY}) END AS win
      FROM tx_events t JOIN sp USING (customer_id))
SELECT customer_id, CAST(win AS BIGINT) AS win, CAST(count(*) AS BIGINT) AS rows FROM w WHERE win IS NOT NULL GROUP BY 1, 2
"""),
    "b09_benford_deviation": _wrap("b13_amount_anomaly", "customer_id, benford_deviation", q_signals),
    "b10_structuring_score": _wrap("b13_amount_anomaly", "customer_id, structuring_score", q_signals),
    "b11_round_amount_ratio": _wrap("b13_amount_anomaly", "customer_id, round_amount_ratio", q_signals),
    "b12_skew_kurtosis": _wrap("b13_amount_anomaly", "customer_id, amount_skewness, amount_kurtosis", q_signals),
    "i01_normalize": with_views("," + q_signals.burst_cte("tx_events") + """
SELECT customer_id, round(greatest(0.0, least(1.0, (burstiness_index - 0) / 1.0)), 6) AS burst_norm,
       round(greatest(0.0, least(1.0, (burst_events - 0) / 30.0)), 6) AS events_norm, CAST(0.5 AS DOUBLE) AS degenerate
FROM bu_out
"""),
    "l03_link_tiers": "SELECT confidence, CAST(count(*) AS BIGINT) AS links FROM ("
                      + q_link.ORACLES["l02_link_fiat_to_crypto"] + ") q GROUP BY 1",
    "l09_wallet_seen": _wrap("l08_wallet_totals", "wallet_id, first_seen_us, last_seen_us", q_link),
    "r04_to_usd": with_views("\nSELECT transaction_id, round(round(amount * usd_rate, 6 + 0), 6) AS usd FROM tx_orders"),
    "r05_usd_amount": with_views("\nSELECT customer_id, round(sum(amount * coalesce(usd_rate, 1.0)), 6) AS usd_total FROM tx_orders GROUP BY 1"),
    "s01_read_tables": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS rows FROM {t}" for t in TB.DRIVER_TABLES) + ")",
}


from driftwatch.operators import features as FT  # noqa: E402
from driftwatch.plans import q_model  # noqa: E402


def q_f03_ppp_asymmetry(spark, sf):
    prep(spark)
    f = FT.traditional_features(V(spark, sf, "customers_v"), V(spark, sf, "tx_orders"))
    return rounded(f.select("customer_id", "avg_ppp_asymmetry"))


def q_f04_merge_features(spark, sf):
    """traditional ⟕ behavioural ⟕ network ⟕ BSI, nulls → 0."""
    prep(spark)
    trad = FT.traditional_features(V(spark, sf, "customers_v"), V(spark, sf, "tx_orders"))
    m = FT.merge_features(trad, q_model.behavioural_stage(spark, sf), q_model.network_stage(spark, sf),
                          q_model.bsi_stage(spark, sf))
    return rounded(m.select("customer_id", "total_transactions", "amount_entropy_drift", "funnel_ratio", "bsi_score"))


QUERIES["f03_ppp_asymmetry"] = q_f03_ppp_asymmetry
QUERIES["f04_merge_features"] = q_f04_merge_features
ORACLES["f03_ppp_asymmetry"] = "SELECT customer_id, avg_ppp_asymmetry FROM (" + q_model.ORACLES["f01_traditional_features"] + ") q"

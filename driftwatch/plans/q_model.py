"""Registered feature / stability / monitoring queries (F01–F05, I01–I04,
M01, M03) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions import dims
from driftwatch.operators import features as FT
from driftwatch.operators import signals as S
from driftwatch.operators import stability as ST
from driftwatch.operators.graph import signals as GS
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.q_graph import (depth_cte, edges_cte, flows_cte,
                                      velocity_cte, cycles3_cte)
from driftwatch.plans.q_signals import (INT_SIGNALS, ORDERS_WINDOW_DAYS,
                                        SIGNAL_COLS_SQL, all_signals_cte)
from driftwatch.plans.stages import stage
from driftwatch.plans.stages import view as V
from driftwatch.sources import tables as TB

RUN_TS = "2025-12-31 00:00:00"


def behavioural(spark, sf):
    return S.all_signals(V(spark, sf, "tx_orders"), V(spark, sf, "customers_v"), window_days=ORDERS_WINDOW_DAYS)


def network(spark, sf):
    return GS.network_signals(V(spark, sf, "tx_orders"), V(spark, sf, "customers_v"))


def bsi_raw(spark, sf):
    """I02 on the stored B14 and G18 stage outputs (its inputs)."""
    return ST.bsi_raw(behavioural_stage(spark, sf), network_stage(spark, sf))


# stage outputs (S10) for the downstream evaluation / dashboard queries
def behavioural_stage(spark, sf):
    from driftwatch.plans.q_signals import behavioural_stage as _b
    return _b(spark, sf)


def network_stage(spark, sf):
    return stage(spark, sf, "network", lambda: network(spark, sf))


def bsi_stage(spark, sf):
    return stage(spark, sf, "bsi", lambda: ST.bsi_rescale(bsi_raw(spark, sf)))


def q_f01_traditional_features(spark, sf):
    prep(spark)
    return rounded(FT.traditional_features(V(spark, sf, "customers_v"), V(spark, sf, "tx_orders")))


def q_f02_rapid_sequence(spark, sf):
    prep(spark)
    return FT.rapid_sequence(V(spark, sf, "tx_events"))


def q_f05_model_matrix(spark, sf):
    """F04 + F05: merged, sanitised 95-feature matrix."""
    prep(spark)
    beh = behavioural_stage(spark, sf)
    net = network_stage(spark, sf)
    bsi = bsi_stage(spark, sf)
    trad = FT.traditional_features(V(spark, sf, "customers_v"), V(spark, sf, "tx_orders"))
    return rounded(FT.sanitize(FT.merge_features(trad, beh, net, bsi)))


def q_g18_network_signals(spark, sf):
    prep(spark)
    return rounded(network_stage(spark, sf))


def q_i02_bsi_raw(spark, sf):
    prep(spark)
    return bsi_raw(spark, sf)


def q_i03_bsi_rescaled(spark, sf):
    prep(spark)
    return ST.bsi_rescale(bsi_raw(spark, sf))


def q_i04_drift_levels(spark, sf):
    prep(spark)
    return ST.bsi_rescale(bsi_raw(spark, sf)).groupBy("drift_level").agg(F.count("*").alias("customers"))


def q_m01_monitoring(spark, sf):
    prep(spark)
    m = ST.monitoring_state(ST.bsi_rescale(bsi_raw(spark, sf)), RUN_TS)
    return m.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


def q_m03_level_counts(spark, sf):
    prep(spark)
    return ST.level_counts(ST.monitoring_state(ST.bsi_rescale(bsi_raw(spark, sf)), RUN_TS))


def q_i05_bsi_timeline(spark, sf):
    """I05 on tx_events: 6-day windows every 3 days (FIXTURES §2)."""
    prep(spark)
    return rounded(ST.bsi_timeline(V(spark, sf, "tx_events"), 6, 3, 3))


def q_m02_sudden_drop(spark, sf):
    prep(spark)
    t = ST.bsi_timeline(V(spark, sf, "tx_events"), 6, 3, 3)
    return rounded(ST.sudden_drop(t.select("customer_id", "window_start_us", "bsi_score")))


def q_m04_streaming_monitor(spark, sf):
    """M02 as a stateful stream over the scored windows, written as Parquet files in no
    order (one file per trigger)."""
    import uuid
    from driftwatch.session import checkpoint_dir
    from driftwatch.streaming import monitor as MS
    prep(spark)
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    out = MS.replay(spark, ST.bsi_timeline(V(spark, sf, "tx_events"), 6, 3, 3), base)
    return rounded(out)


QUERIES = {
    "m04_streaming_monitor": q_m04_streaming_monitor,
    "i05_bsi_timeline": q_i05_bsi_timeline,
    "m02_sudden_drop": q_m02_sudden_drop,
    "f01_traditional_features": q_f01_traditional_features,
    "f02_rapid_sequence": q_f02_rapid_sequence,
    "f05_model_matrix": q_f05_model_matrix,
    "g18_network_signals": q_g18_network_signals,
    "i02_bsi_raw": q_i02_bsi_raw,
    "i03_bsi_rescaled": q_i03_bsi_rescaled,
    "i04_drift_levels": q_i04_drift_levels,
    "m01_monitoring": q_m01_monitoring,
    "m03_level_counts": q_m03_level_counts,
}

# ----------------------------------------------------------------- DuckDB side
DAY = 86400000000


def _case(expr, mapping, default):
    w = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {w} ELSE {float(default)} END)"


HR = ", ".join(f"'{c}'" for c in dims.HIGH_RISK_COUNTRIES)
PPL = _case("country", dims.COUNTRY_PPL, dims.DEFAULT_PPL)

TRAD_CTE = f"""
f_t AS (SELECT * FROM tx_orders WHERE customer_id IN (SELECT customer_id FROM customers_v)),
f_g AS (SELECT customer_id, ts_us - lag(ts_us) OVER (PARTITION BY customer_id ORDER BY ts_us) AS gap FROM f_t),
f_r AS (SELECT customer_id, count(*) FILTER (WHERE gap < {2 * DAY}) AS nr FROM f_g GROUP BY 1),
f_a AS (
  SELECT customer_id, count(*) AS n, sum(amount) AS total_volume, avg(amount) AS avg_amt, max(amount) AS max_amt,
    stddev_samp(amount) AS sd, min(ts_us) AS mn, max(ts_us) AS mx,
    count(*) FILTER (WHERE transaction_type = 'deposit') AS nd,
    count(*) FILTER (WHERE transaction_type = 'withdrawal') AS nw,
    coalesce(sum(amount) FILTER (WHERE transaction_type = 'deposit'), 0) AS td,
    coalesce(sum(amount) FILTER (WHERE transaction_type = 'withdrawal'), 0) AS tw,
    count(*) FILTER (WHERE method = 'cash') AS ncash, count(*) FILTER (WHERE method = 'wire') AS nwire,
    coalesce(sum(amount) FILTER (WHERE method = 'cash'), 0) AS tcash,
    count(*) FILTER (WHERE country IS DISTINCT FROM 'USA') AS nintl,
    count(*) FILTER (WHERE country IN ({HR})) AS nhr,
    coalesce(sum(amount) FILTER (WHERE country IS DISTINCT FROM 'USA'), 0) AS tintl,
    count(*) FILTER (WHERE amount >= 7000 AND amount < 10000) AS nband,
    sum(amount * coalesce(usd_rate, 1.0)) AS usd,
    avg(CASE WHEN country IS DISTINCT FROM 'USA' AND method = 'wire' THEN
          CASE WHEN transaction_type = 'deposit' THEN ln(1.0 / {PPL}) ELSE ln({PPL} / 1.0) END END) AS ppp,
    count(DISTINCT counterparty) AS ncp, count(DISTINCT location) AS nloc,
    count(*) FILTER (WHERE method = 'crypto_exchange') AS ncry,
    coalesce(sum(amount) FILTER (WHERE method = 'crypto_exchange'), 0) AS tcry,
    count(DISTINCT currency) AS ncur
  FROM f_t GROUP BY 1
),
f_out AS (
  SELECT a.customer_id,
    CASE WHEN c.customer_type = 'business' THEN 1 ELSE 0 END AS customer_type_business,
    c.annual_income,
    CAST(DATE '{dims.ACCOUNT_AGE_REFERENCE}' - c.account_open_date AS BIGINT) AS account_age_days,
    CAST(n AS BIGINT) AS total_transactions, total_volume, avg_amt AS avg_transaction_amount,
    max_amt AS max_transaction_amount, CASE WHEN n > 1 THEN sd ELSE 0 END AS std_transaction_amount,
    CAST(greatest(floor((mx - mn) / {DAY}), 1) AS BIGINT) AS transaction_date_range_days,
    CAST(nd AS BIGINT) AS num_deposits, CAST(nw AS BIGINT) AS num_withdrawals, nd / (nw + 1) AS deposit_withdrawal_ratio,
    td AS total_deposits, tw AS total_withdrawals,
    CAST(ncash AS BIGINT) AS num_cash_txns, CAST(nwire AS BIGINT) AS num_wire_txns,
    ncash / n AS pct_cash, nwire / n AS pct_wire, tcash AS total_cash_amount,
    CAST(nintl AS BIGINT) AS num_intl_txns, CAST(nhr AS BIGINT) AS num_high_risk_country_txns,
    nintl / n AS pct_intl, tintl AS total_intl_amount,
    CAST(nband AS BIGINT) AS num_just_under_10k, nband / n AS pct_just_under_10k,
    CAST(r.nr AS BIGINT) AS num_rapid_sequence_txns,
    CAST(CASE WHEN n >= 2 THEN floor((mx - mn) / ((n - 1) * {DAY})) ELSE 0 END AS BIGINT) AS avg_days_between_txns,
    usd / (c.annual_income + 1) AS volume_to_income_ratio, usd AS usd_volume, ln(1 + usd) AS log_usd_volume,
    coalesce(round(ppp, 4), 0.0) AS avg_ppp_asymmetry,
    CAST(ncp AS BIGINT) AS num_unique_counterparties, CAST(nloc AS BIGINT) AS num_unique_locations,
    CAST(ncry AS BIGINT) AS num_crypto_txns, tcry AS total_crypto_volume,
    CASE WHEN ncry > 0 THEN ln(1 + tcry) ELSE 0 END AS log_crypto_volume,
    CAST(ncur AS BIGINT) AS num_currencies_used,
    CASE WHEN ncry > 0 THEN tcry / (c.annual_income + 1) ELSE 0 END AS crypto_volume_to_income_ratio,
    CAST(c.is_suspicious AS INTEGER) AS is_suspicious,
    CASE WHEN c.is_suspicious THEN c.typology ELSE 'normal' END AS typology
  FROM f_a a JOIN customers_v c USING (customer_id) JOIN f_r r USING (customer_id)
)"""

TRAD_INT = {"customer_type_business", "account_age_days", "total_transactions", "transaction_date_range_days",
            "num_deposits", "num_withdrawals", "num_cash_txns", "num_wire_txns", "num_intl_txns",
            "num_high_risk_country_txns", "num_just_under_10k", "num_rapid_sequence_txns",
            "avg_days_between_txns", "num_unique_counterparties", "num_unique_locations",
            "num_crypto_txns", "num_currencies_used", "is_suspicious", "typology"}


def _sel(cols, src, ints):
    return "SELECT customer_id, " + ", ".join(c if c in ints else f"round({c}, 6) AS {c}" for c in cols) + f" FROM {src}"


def n01(v, lo, hi):
    return f"greatest(0.0, least(1.0, ({v} - {lo}) / ({hi} - {lo})))"


BSI_CTE = (""",
tx_known AS (SELECT * FROM tx_orders WHERE customer_id IN (SELECT customer_id FROM customers_v)),"""
           + all_signals_cte("tx_known", ORDERS_WINDOW_DAYS) + "," + edges_cte("tx_orders", "n_") + ","
           + flows_cte("n_") + "," + depth_cte("n_") + "," + velocity_cte("tx_orders", "customers_v", "v_") + ","
           + cycles3_cte("n_") + f""",
net AS (
  SELECT * FROM n_circ JOIN n_flows USING (customer_id) JOIN n_depth USING (customer_id) JOIN v_vel USING (customer_id)
),
mrg AS (SELECT * FROM sg_out JOIN net USING (customer_id)),
dims5 AS (
  SELECT customer_id,
    1 - {n01('(amount_entropy_drift + timing_entropy_drift + counterparty_entropy_drift) / 3', 0, 2.0)} AS e,
    (1 - {n01('greatest(burstiness_index, 0)', 0, 1.0)}) * 0.4 + (1 - {n01('burst_events', 0, 30)}) * 0.3
      + (1 - {n01('max_daily_count', 0, 15)}) * 0.3 AS t,
    (1 - {n01('counterparty_expansion_rate', 0, 15)}) * 0.4 + (1 - {n01('abs(counterparty_novelty_slope)', 0, 3)}) * 0.3
      + (1 - {n01('total_unique_counterparties', 0, 80)}) * 0.3 AS c,
    1 - ({n01('benford_deviation', 0, 1.5)} * 0.3 + {n01('structuring_score', 0, 0.3)} * 0.3
         + {n01('abs(amount_skewness)', 0, 5)} * 0.2 + {n01('abs(amount_kurtosis)', 0, 20)} * 0.2) AS a,
    1 - ({n01('funnel_ratio', 1, 8)} * 0.2 + {n01('layer_depth', 0, 6)} * 0.2 + {n01('flow_velocity', 0, 0.3)} * 0.15
         + CASE WHEN has_circular_flow THEN 0.15 ELSE 0 END + CASE WHEN is_funnel_hub THEN 0.15 ELSE 0 END
         + {n01('rapid_passthrough_count', 0, 10)} * 0.15) AS nw
  FROM mrg
),
bsi_raw AS (
  SELECT customer_id, round((e * 0.25 + t * 0.20 + c * 0.20 + a * 0.20 + nw * 0.15) * 100, 2) AS bsi_score,
    round(e * 100, 2) AS entropy_stability, round(t * 100, 2) AS temporal_stability,
    round(c * 100, 2) AS counterparty_stability, round(a * 100, 2) AS amount_stability,
    round(nw * 100, 2) AS network_stability
  FROM dims5
),
q AS (SELECT quantile_cont(bsi_score, 0.05) AS p5, quantile_cont(bsi_score, 0.95) AS p95 FROM bsi_raw),
bsi AS (
  SELECT customer_id,
    CASE WHEN p95 > p5 THEN round(greatest(2.0, least(98.0, (bsi_score - p5) / (p95 - p5) * 90 + 5)), 2) ELSE bsi_score END AS bsi_score,
    entropy_stability, temporal_stability, counterparty_stability, amount_stability, network_stability
  FROM bsi_raw CROSS JOIN q
),
lv AS (
  SELECT *, CASE WHEN bsi_score <= 25 THEN 'critical' WHEN bsi_score <= 50 THEN 'high'
                 WHEN bsi_score <= 75 THEN 'moderate' ELSE 'stable' END AS drift_level,
            CASE WHEN bsi_score <= 25 THEN 'immediate' WHEN bsi_score <= 50 THEN 'intensive'
                 WHEN bsi_score <= 75 THEN 'enhanced' ELSE 'standard' END AS monitoring_level
  FROM bsi
)""")

LEVEL_CASE = {k: v for k, v in dims.MONITORING_LEVELS.items()}


def _lvl_case(idx, cast=""):
    w = " ".join(f"WHEN '{k}' THEN {repr(v[idx]) if isinstance(v[idx], str) else v[idx]}" for k, v in LEVEL_CASE.items())
    w = w.replace('"', "'")
    return f"CAST(CASE monitoring_level {w} END AS {cast})" if cast else f"CASE monitoring_level {w} END"


NET_SQL = ("has_circular_flow, num_cycles, max_cycle_length, round(cycle_total_amount, 6) AS cycle_total_amount, "
           "is_funnel_hub, in_degree, out_degree, round(funnel_ratio, 6) AS funnel_ratio, round(total_inflow, 6) AS total_inflow, "
           "round(total_outflow, 6) AS total_outflow, layer_depth, reachable_nodes, round(flow_velocity, 6) AS flow_velocity, "
           "round(avg_retention_hours, 6) AS avg_retention_hours, rapid_passthrough_count")

ORACLES = {
    "f01_traditional_features": with_views("," + TRAD_CTE + "\n"
                                           + _sel(FT.TRADITIONAL_COLS + ["is_suspicious", "typology"], "f_out", TRAD_INT)),
    "f02_rapid_sequence": with_views(f""",
g AS (SELECT customer_id, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY customer_id ORDER BY ts_us) AS gap FROM tx_events)
SELECT customer_id, CAST(count(*) FILTER (WHERE gap < {2 * DAY}) AS BIGINT) AS num_rapid_sequence_txns,
  CAST(CASE WHEN count(*) >= 2 THEN floor((max(ts_us) - min(ts_us)) / ((count(*) - 1) * {DAY})) ELSE 0 END AS BIGINT) AS avg_days_between_txns
FROM g GROUP BY 1
"""),
    "g18_network_signals": with_views(BSI_CTE + f"\nSELECT customer_id, {NET_SQL} FROM net"),
    "i02_bsi_raw": with_views(BSI_CTE + """
SELECT *, CASE WHEN bsi_score <= 25 THEN 'critical' WHEN bsi_score <= 50 THEN 'high'
               WHEN bsi_score <= 75 THEN 'moderate' ELSE 'stable' END AS drift_level FROM bsi_raw
"""),
    "i03_bsi_rescaled": with_views(BSI_CTE + """
SELECT customer_id, bsi_score, drift_level, entropy_stability, temporal_stability, counterparty_stability,
       amount_stability, network_stability FROM lv
"""),
    "i04_drift_levels": with_views(BSI_CTE + "\nSELECT drift_level, CAST(count(*) AS BIGINT) AS customers FROM lv GROUP BY 1"),
    "m01_monitoring": with_views(BSI_CTE + f"""
SELECT customer_id, monitoring_level, {_lvl_case(0, 'BIGINT')} AS check_interval_days,
       {_lvl_case(1, 'DOUBLE')} AS anomaly_threshold, {_lvl_case(2)} AS recommended_action,
       false AS sudden_drop_detected, monitoring_level IN ('immediate', 'intensive') AS escalation_triggered,
       bsi_score, drift_level, '{RUN_TS}' AS "timestamp"
FROM lv
"""),
    "m03_level_counts": with_views(BSI_CTE + """
SELECT monitoring_level, monitoring_level IN ('immediate', 'intensive') AS escalation_triggered,
       CAST(count(*) AS BIGINT) AS customers FROM lv GROUP BY 1, 2
"""),
}


# ------------------------------------------------------------ I05 / M02 oracle
def bsi_sql(rel: str, p: str) -> str:
    """CTEs ``{p}bsi`` (raw index, level, dimensions) from a relation holding
    the behavioural + network signal columns."""
    return f"""
{p}d AS (
  SELECT customer_id,
    1 - {n01('(amount_entropy_drift + timing_entropy_drift + counterparty_entropy_drift) / 3', 0, 2.0)} AS e,
    (1 - {n01('greatest(burstiness_index, 0)', 0, 1.0)}) * 0.4 + (1 - {n01('burst_events', 0, 30)}) * 0.3
      + (1 - {n01('max_daily_count', 0, 15)}) * 0.3 AS t,
    (1 - {n01('counterparty_expansion_rate', 0, 15)}) * 0.4 + (1 - {n01('abs(counterparty_novelty_slope)', 0, 3)}) * 0.3
      + (1 - {n01('total_unique_counterparties', 0, 80)}) * 0.3 AS c,
    1 - ({n01('benford_deviation', 0, 1.5)} * 0.3 + {n01('structuring_score', 0, 0.3)} * 0.3
         + {n01('abs(amount_skewness)', 0, 5)} * 0.2 + {n01('abs(amount_kurtosis)', 0, 20)} * 0.2) AS a,
    1 - ({n01('funnel_ratio', 1, 8)} * 0.2 + {n01('layer_depth', 0, 6)} * 0.2 + {n01('flow_velocity', 0, 0.3)} * 0.15
         + CASE WHEN has_circular_flow THEN 0.15 ELSE 0 END + CASE WHEN is_funnel_hub THEN 0.15 ELSE 0 END
         + {n01('rapid_passthrough_count', 0, 10)} * 0.15) AS nw
  FROM {rel}
),
{p}bsi AS (
  SELECT customer_id, round((e * 0.25 + t * 0.20 + c * 0.20 + a * 0.20 + nw * 0.15) * 100, 2) AS bsi_score,
    round(e * 100, 2) AS entropy_stability, round(t * 100, 2) AS temporal_stability,
    round(c * 100, 2) AS counterparty_stability, round(a * 100, 2) AS amount_stability,
    round(nw * 100, 2) AS network_stability
  FROM {p}d
)"""


def timeline_sql(src: str, w_days: int, s_days: int, sig_days: int) -> str:
    W, S, F_ = w_days * DAY, s_days * DAY, 100000
    per = -(-w_days // s_days)
    js = " UNION ALL ".join(
        f"SELECT t.*, sp.mn, sp.mx, floor((t.ts_us - sp.mn) / {S}) - {k} AS win_j FROM {src} t JOIN tl_sp sp USING (customer_id) WHERE sp.n >= 5"
        for k in range(per))
    return f"""
tl_sp AS (SELECT customer_id, min(ts_us) AS mn, max(ts_us) AS mx, count(*) AS n FROM {src} GROUP BY 1),
tl_x0 AS ({js}),
tl_x AS (SELECT * FROM tl_x0 WHERE win_j >= 0 AND ts_us >= mn + win_j * {S} AND ts_us < mn + win_j * {S} + {W}
                                 AND mn + win_j * {S} + {W} <= mx + {DAY}),
tl_c AS (SELECT customer_id, win_j, count(*) AS num_transactions, sum(amount) AS total_volume, any_value(mn) AS mn
         FROM tl_x GROUP BY 1, 2 HAVING count(*) >= 3),
tl_rows AS (SELECT x.* REPLACE (CAST(x.customer_id * {F_} + x.win_j AS BIGINT) AS customer_id), x.customer_id AS owner
            FROM tl_x x JOIN tl_c USING (customer_id, win_j)),
tl_ids AS (SELECT DISTINCT customer_id FROM tl_rows),
{all_signals_cte('tl_rows', sig_days, 'ts_')},
{velocity_cte('tl_rows', 'tl_ids', 'tv_')},
tl_star AS (
  SELECT customer_id,
    count(DISTINCT CASE WHEN counterparty IS NOT NULL AND counterparty NOT IN ('', 'None', 'nan') THEN counterparty END) AS out_degree,
    coalesce(bool_or(counterparty IS NOT NULL AND counterparty NOT IN ('', 'None', 'nan')
                     AND counterparty = CAST(owner AS VARCHAR)), false) AS has_circular_flow
  FROM tl_rows GROUP BY 1),
tl_net AS (
  SELECT s.customer_id, s.has_circular_flow, CASE WHEN s.out_degree > 0 THEN 1 ELSE 0 END AS layer_depth,
    CAST(s.out_degree AS DOUBLE) AS funnel_ratio, s.out_degree >= 4 AS is_funnel_hub, v.flow_velocity, v.rapid_passthrough_count
  FROM tl_star s JOIN tv_vel v USING (customer_id)),
tl_m AS (SELECT * FROM ts_out JOIN tl_net USING (customer_id)),
{bsi_sql('tl_m', 'tb_')},
timeline AS (
  SELECT c.customer_id, CAST(c.win_j AS BIGINT) AS window_index,
    CAST(c.mn + c.win_j * {S} AS BIGINT) AS window_start_us, CAST(c.mn + c.win_j * {S} + {W} AS BIGINT) AS window_end_us,
    CAST(c.mn + c.win_j * {S} + {(w_days // 2) * DAY} AS BIGINT) AS window_midpoint_us,
    CAST(c.num_transactions AS BIGINT) AS num_transactions, c.total_volume, b.bsi_score,
    CASE WHEN b.bsi_score <= 25 THEN 'critical' WHEN b.bsi_score <= 50 THEN 'high'
         WHEN b.bsi_score <= 75 THEN 'moderate' ELSE 'stable' END AS drift_level,
    b.entropy_stability, b.temporal_stability, b.counterparty_stability, b.amount_stability, b.network_stability
  FROM tl_c c JOIN tb_bsi b ON b.customer_id = c.customer_id * {F_} + c.win_j)"""


ORACLES["i05_bsi_timeline"] = with_views("," + timeline_sql("tx_events", 6, 3, 3) + """
SELECT customer_id, window_index, window_start_us, window_end_us, window_midpoint_us, num_transactions,
  round(total_volume, 6) AS total_volume, round(bsi_score, 6) AS bsi_score, drift_level,
  round(entropy_stability, 6) AS entropy_stability, round(temporal_stability, 6) AS temporal_stability,
  round(counterparty_stability, 6) AS counterparty_stability, round(amount_stability, 6) AS amount_stability,
  round(network_stability, 6) AS network_stability
FROM timeline
""")
ORACLES["m02_sudden_drop"] = with_views("," + timeline_sql("tx_events", 6, 3, 3) + """,
lg AS (SELECT customer_id, window_start_us, bsi_score,
              lag(bsi_score) OVER (PARTITION BY customer_id ORDER BY window_start_us) AS previous_bsi FROM timeline),
lv2 AS (SELECT *, coalesce(previous_bsi - bsi_score > 20, false) AS sudden FROM lg),
lv3 AS (SELECT *, CASE WHEN bsi_score <= 25 OR sudden THEN 'immediate' WHEN bsi_score <= 50 THEN 'intensive'
                       WHEN bsi_score <= 75 THEN 'enhanced' ELSE 'standard' END AS monitoring_level FROM lv2)
SELECT customer_id, window_start_us, round(bsi_score, 6) AS bsi_score, round(previous_bsi, 6) AS previous_bsi,
  monitoring_level,
  CAST(CASE monitoring_level WHEN 'standard' THEN 30 WHEN 'enhanced' THEN 7 WHEN 'intensive' THEN 1 ELSE 0 END AS BIGINT) AS check_interval_days,
  CASE monitoring_level WHEN 'standard' THEN CAST(0.7 AS DOUBLE) WHEN 'enhanced' THEN CAST(0.5 AS DOUBLE)
       WHEN 'intensive' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS anomaly_threshold,
  CASE monitoring_level WHEN 'standard' THEN 'Behavioral consistency maintained. Low risk.'
       WHEN 'enhanced' THEN 'Review transaction context and patterns.'
       WHEN 'intensive' THEN 'Enhanced monitoring required. Lower anomaly thresholds.'
       ELSE 'Immediate investigation warranted. SAR review initiated.' END AS recommended_action,
  sudden AS sudden_drop_detected, monitoring_level IN ('immediate', 'intensive') OR sudden AS escalation_triggered
FROM lv3
""")

# the stream gives M02's decisions without their texts
ORACLES["m04_streaming_monitor"] = f"""
SELECT customer_id, window_start_us, bsi_score, previous_bsi, monitoring_level, sudden_drop_detected, escalation_triggered
FROM ({ORACLES["m02_sudden_drop"]})
"""

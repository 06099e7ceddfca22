"""Registered queries B01–B14 and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions.exprs import entropy_agg
from driftwatch.operators import signals as S
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.stages import view as V
from driftwatch.sources import tables as TB

ORDERS_WINDOW_DAYS = 180   # FIXTURES §2: 30-day windows are too sparse on tx_orders
EVENTS_WINDOW_DAYS = 3


def q_b01_entropy(spark, sf):
    """B01 on a categorical column: entropy of payment method per customer."""
    prep(spark)
    t = V(spark, sf, "tx_orders")
    c = t.groupBy("customer_id", "method").agg(F.count("*").alias("n"))
    return rounded(c.groupBy("customer_id").agg(entropy_agg("n").alias("method_entropy")))


def q_b04_entropies(spark, sf):
    """B02–B04 over each customer's whole history (tx_events)."""
    prep(spark)
    return rounded(S.grouped_entropies(V(spark, sf, "tx_events"), ["customer_id"]))


def q_b06_entropy_drift(spark, sf):
    prep(spark)
    return rounded(S.entropy_drift(V(spark, sf, "tx_orders"), ORDERS_WINDOW_DAYS))


def q_b06_entropy_drift_events(spark, sf):
    prep(spark)
    return rounded(S.entropy_drift(V(spark, sf, "tx_events"), EVENTS_WINDOW_DAYS))


def q_b07_temporal_burst(spark, sf):
    prep(spark)
    return rounded(S.temporal_burst(V(spark, sf, "tx_events")))


def q_b07_temporal_burst_orders(spark, sf):
    prep(spark)
    return rounded(S.temporal_burst(V(spark, sf, "tx_orders")))


def q_b08_counterparty_expansion(spark, sf):
    prep(spark)
    return rounded(S.counterparty_expansion(V(spark, sf, "tx_orders"), ORDERS_WINDOW_DAYS))


def q_b08_counterparty_expansion_events(spark, sf):
    prep(spark)
    return rounded(S.counterparty_expansion(V(spark, sf, "tx_events"), EVENTS_WINDOW_DAYS))


def q_b13_amount_anomaly(spark, sf):
    prep(spark)
    return rounded(S.amount_anomaly(V(spark, sf, "tx_orders")))


def behavioural_stage(spark, sf):
    """B14 stage output (S10): computed once per application, reused downstream."""
    from driftwatch.plans.stages import stage
    return stage(spark, sf, "behavioural", lambda: S.all_signals(
        V(spark, sf, "tx_orders"), V(spark, sf, "customers_v"), window_days=ORDERS_WINDOW_DAYS))


def q_b14_all_signals(spark, sf):
    prep(spark)
    return rounded(behavioural_stage(spark, sf))


QUERIES = {
    "b01_entropy": q_b01_entropy,
    "b04_entropies": q_b04_entropies,
    "b06_entropy_drift": q_b06_entropy_drift,
    "b06_entropy_drift_events": q_b06_entropy_drift_events,
    "b07_temporal_burst": q_b07_temporal_burst,
    "b07_temporal_burst_orders": q_b07_temporal_burst_orders,
    "b08_counterparty_expansion": q_b08_counterparty_expansion,
    "b08_counterparty_expansion_events": q_b08_counterparty_expansion_events,
    "b13_amount_anomaly": q_b13_amount_anomaly,
    "b14_all_signals": q_b14_all_signals,
}

# ----------------------------------------------------------------- DuckDB side
DAY = 86400000000


def ent_cte(src: str, keys: str, p: str) -> str:
    """CTEs ending in ``{p}ents(keys, amount_entropy, timing_entropy, counterparty_entropy)``."""
    return f"""
{p}mm AS (SELECT {keys}, min(amount) AS amin, max(amount) AS amax, count(*) AS n FROM {src} GROUP BY {keys}),
{p}rows AS (
  SELECT s.*, m.amin, m.amax, m.n,
         least(9, floor((s.amount - m.amin) / ((m.amax + 1) - m.amin) * 10)) AS abin,
         ((floor(s.ts_us / {DAY}) + 3) % 7) AS wd
  FROM {src} s JOIN {p}mm m USING ({keys})
),
{p}a AS (SELECT {keys}, abin, count(*) AS c, any_value(n) AS n FROM {p}rows GROUP BY {keys}, abin),
{p}t AS (SELECT {keys}, wd, count(*) AS c, any_value(n) AS n FROM {p}rows GROUP BY {keys}, wd),
{p}c AS (SELECT {keys}, counterparty, count(*) AS c FROM {p}rows
        WHERE counterparty IS NOT NULL AND counterparty <> '' GROUP BY {keys}, counterparty),
{p}ct AS (SELECT {keys}, c, sum(c) OVER (PARTITION BY {keys}) AS tot FROM {p}c),
{p}ha AS (SELECT {keys}, CASE WHEN any_value(n) >= 2 THEN -sum((c / n) * log2(c / n)) ELSE 0 END AS amount_entropy FROM {p}a GROUP BY {keys}),
{p}ht AS (SELECT {keys}, CASE WHEN any_value(n) >= 2 THEN -sum((c / n) * log2(c / n)) ELSE 0 END AS timing_entropy FROM {p}t GROUP BY {keys}),
{p}hc AS (SELECT {keys}, CASE WHEN any_value(tot) >= 2 THEN -sum((c / tot) * log2(c / tot)) ELSE 0 END AS counterparty_entropy FROM {p}ct GROUP BY {keys}),
{p}ents AS (
  SELECT {keys}, {p}ha.amount_entropy, {p}ht.timing_entropy, coalesce({p}hc.counterparty_entropy, 0) AS counterparty_entropy
  FROM {p}ha JOIN {p}ht USING ({keys}) LEFT JOIN {p}hc USING ({keys})
)"""


def drift_cte(src: str, w_days: int, p: str = "dr_") -> str:
    """CTEs ending in ``{p}out`` with the B06 columns per customer."""
    w = w_days * DAY
    return f"""
{p}sp AS (SELECT customer_id, min(ts_us) AS mn, max(ts_us) AS mx FROM {src} GROUP BY customer_id),
{p}wrows AS (
  SELECT t.*, CASE WHEN floor((sp.mx - sp.mn) / {DAY}) < {2 * w_days} THEN -1
                   WHEN sp.mn + (floor((t.ts_us - sp.mn) / {w}) + 1) * {w} <= sp.mx
                   THEN floor((t.ts_us - sp.mn) / {w}) END AS win
  FROM {src} t JOIN {p}sp sp USING (customer_id)
),
{p}wr AS (SELECT * FROM {p}wrows WHERE win IS NOT NULL),
{ent_cte(p + 'wr', 'customer_id, win', p + 'e_')},
{p}steps AS (
  SELECT customer_id, win, amount_entropy, timing_entropy, counterparty_entropy,
    abs(amount_entropy - lag(amount_entropy) OVER (PARTITION BY customer_id ORDER BY win)) AS da,
    abs(timing_entropy - lag(timing_entropy) OVER (PARTITION BY customer_id ORDER BY win)) AS dt,
    abs(counterparty_entropy - lag(counterparty_entropy) OVER (PARTITION BY customer_id ORDER BY win)) AS dc
  FROM {p}e_ents
),
{p}out AS (
  SELECT customer_id,
    coalesce(max(da), 0) AS amount_entropy_drift, coalesce(max(dt), 0) AS timing_entropy_drift,
    coalesce(max(dc), 0) AS counterparty_entropy_drift,
    avg(amount_entropy) AS mean_amount_entropy, avg(timing_entropy) AS mean_timing_entropy,
    avg(counterparty_entropy) AS mean_counterparty_entropy,
    coalesce(max(da), 0) AS entropy_drift, CAST(count(*) AS BIGINT) AS num_windows
  FROM {p}steps GROUP BY customer_id
)"""


def burst_cte(src: str, p: str = "bu_") -> str:
    return f"""
{p}g AS (SELECT customer_id, ts_us, (ts_us - lag(ts_us) OVER (PARTITION BY customer_id ORDER BY ts_us)) / 3600000000.0 AS gap
      FROM {src}),
{p}st AS (SELECT customer_id, count(*) AS n, avg(gap) AS m, stddev_samp(gap) AS s, var_samp(gap) AS v,
              count(*) FILTER (WHERE gap < 24) AS b FROM {p}g GROUP BY customer_id),
{p}dd AS (SELECT customer_id, floor(ts_us / {DAY}) AS d, count(*) AS c FROM {src} GROUP BY 1, 2),
{p}da AS (SELECT customer_id, max(c) AS maxd, avg(c) AS meand FROM {p}dd GROUP BY 1),
{p}out AS (
  SELECT customer_id,
    CASE WHEN n >= 3 AND s + m > 0 THEN (s - m) / (s + m) ELSE 0 END AS burstiness_index,
    CAST(CASE WHEN n >= 3 THEN b ELSE 0 END AS BIGINT) AS burst_events,
    CASE WHEN n >= 3 THEN coalesce(v, 0) ELSE 0 END AS inter_arrival_variance,
    CAST(CASE WHEN n >= 3 THEN maxd ELSE 0 END AS BIGINT) AS max_daily_count,
    CASE WHEN n >= 3 THEN meand ELSE 0 END AS mean_daily_count
  FROM {p}st JOIN {p}da USING (customer_id)
)"""


def expansion_cte(src: str, w_days: int, p: str = "ex_") -> str:
    w = w_days * DAY
    return f"""
{p}na AS (SELECT customer_id, count(*) AS n_all FROM {src} GROUP BY 1),
{p}v AS (SELECT * FROM {src} WHERE counterparty IS NOT NULL AND counterparty <> ''),
{p}vs AS (SELECT customer_id, min(ts_us) AS vmin, max(ts_us) AS vmax, count(*) AS nv FROM {p}v GROUP BY 1),
{p}kw AS (SELECT customer_id, floor((vmax + {DAY} - vmin) / {w}) AS kk, vmin, nv FROM {p}vs),
{p}grid AS (SELECT customer_id, unnest(range(0, CAST(kk AS BIGINT))) AS k FROM {p}kw WHERE kk >= 1),
{p}fs AS (SELECT v.customer_id, v.counterparty, min(floor((v.ts_us - kw.vmin) / {w})) AS k
       FROM {p}v v JOIN {p}kw kw USING (customer_id) GROUP BY 1, 2),
{p}per AS (SELECT g.customer_id, g.k, count(fs.counterparty) AS y
        FROM {p}grid g LEFT JOIN {p}fs fs ON g.customer_id = fs.customer_id AND g.k = fs.k GROUP BY 1, 2),
{p}agg AS (SELECT customer_id, avg(y) AS rate, regr_slope(y, k) AS slope, sum(y) AS tot FROM {p}per GROUP BY 1),
{p}out AS (
  SELECT na.customer_id,
    CASE WHEN na.n_all >= 2 AND coalesce(kw.nv, 0) >= 2 AND kw.kk >= 1 THEN agg.rate ELSE 0 END AS counterparty_expansion_rate,
    CASE WHEN na.n_all >= 2 AND coalesce(kw.nv, 0) >= 2 AND kw.kk >= 2 THEN agg.slope ELSE 0 END AS counterparty_novelty_slope,
    CAST(CASE WHEN na.n_all >= 2 AND coalesce(kw.nv, 0) >= 2 AND kw.kk >= 1 THEN agg.tot ELSE 0 END AS BIGINT) AS total_unique_counterparties
  FROM {p}na na LEFT JOIN {p}kw kw USING (customer_id) LEFT JOIN {p}agg agg USING (customer_id)
)"""


def amount_cte(src: str, p: str = "am_") -> str:
    return f"""
{p}n AS (SELECT customer_id, count(*) AS n FROM {src} GROUP BY 1),
{p}p AS (SELECT customer_id, amount, regexp_extract(CAST(amount AS VARCHAR), '[1-9]', 0) AS dg FROM {src} WHERE amount > 0),
{p}mu AS (SELECT customer_id, avg(amount) AS mu, count(*) AS np FROM {p}p GROUP BY 1),
{p}m AS (SELECT p.customer_id, any_value(m.np) AS np,
               avg(power(p.amount - m.mu, 2)) AS m2, avg(power(p.amount - m.mu, 3)) AS m3, avg(power(p.amount - m.mu, 4)) AS m4,
               count(*) FILTER (WHERE p.amount >= 7000 AND p.amount < 10000) AS ns,
               count(*) FILTER (WHERE p.amount % 100 = 0 OR p.amount % 1000 = 0) AS nr
        FROM {p}p p JOIN {p}mu m USING (customer_id) GROUP BY 1),
{p}digits AS (SELECT unnest(range(1, 10)) AS d),
{p}dc AS (SELECT customer_id, CAST(dg AS INTEGER) AS d, count(*) AS c FROM {p}p GROUP BY 1, 2),
{p}bf AS (SELECT m.customer_id, sum(abs(coalesce(dc.c, 0) / m.np - log10(1 + 1 / dd.d))) AS bf
         FROM {p}mu m CROSS JOIN {p}digits dd LEFT JOIN {p}dc dc ON dc.customer_id = m.customer_id AND dc.d = dd.d
         GROUP BY 1),
{p}out AS (
  SELECT n.customer_id,
    CASE WHEN n.n >= 5 AND coalesce(m.np, 0) >= 5 THEN bf.bf ELSE 0 END AS benford_deviation,
    CASE WHEN n.n >= 5 AND coalesce(m.np, 0) >= 5 THEN m.ns / m.np ELSE 0 END AS structuring_score,
    CASE WHEN n.n >= 5 AND coalesce(m.np, 0) >= 5 THEN m.nr / m.np ELSE 0 END AS round_amount_ratio,
    CASE WHEN n.n >= 5 AND coalesce(m.np, 0) >= 5 AND m.m2 > 0 THEN m.m3 / power(m.m2, 1.5) ELSE 0 END AS amount_skewness,
    CASE WHEN n.n >= 5 AND coalesce(m.np, 0) >= 5 AND m.m2 > 0 THEN m.m4 / (m.m2 * m.m2) - 3 ELSE 0 END AS amount_kurtosis
  FROM {p}n n LEFT JOIN {p}m m USING (customer_id) LEFT JOIN {p}bf bf USING (customer_id)
)"""


SIGNAL_COLS_SQL = ("amount_entropy_drift timing_entropy_drift counterparty_entropy_drift mean_amount_entropy "
                   "mean_timing_entropy mean_counterparty_entropy burstiness_index burst_events "
                   "inter_arrival_variance max_daily_count mean_daily_count counterparty_expansion_rate "
                   "counterparty_novelty_slope total_unique_counterparties benford_deviation structuring_score "
                   "round_amount_ratio amount_skewness amount_kurtosis").split()
INT_SIGNALS = {"burst_events", "max_daily_count", "total_unique_counterparties"}


def all_signals_cte(src: str, w_days: int, p: str = "sg_") -> str:
    """CTEs ending in ``{p}out``: the 19 B14 columns (src already restricted)."""
    return (drift_cte(src, w_days, p + "d_") + "," + burst_cte(src, p + "b_") + ","
            + expansion_cte(src, w_days, p + "x_") + "," + amount_cte(src, p + "a_") + f""",
{p}out AS (
  SELECT d.customer_id, {', '.join(c for c in SIGNAL_COLS_SQL)}
  FROM {p}d_out d JOIN {p}b_out USING (customer_id) JOIN {p}x_out USING (customer_id) JOIN {p}a_out USING (customer_id)
)""")


def sel_round(cols: list[str], src: str, ints=(), key: str = "customer_id") -> str:
    parts = [key] if key else []
    for c in cols:
        parts.append(c if c in ints else f"round({c}, 6) AS {c}")
    return f"SELECT {', '.join(parts)} FROM {src}"


ENT_OUT = ("amount_entropy_drift timing_entropy_drift counterparty_entropy_drift mean_amount_entropy "
           "mean_timing_entropy mean_counterparty_entropy entropy_drift").split()
BURST_OUT = "burstiness_index burst_events inter_arrival_variance max_daily_count mean_daily_count".split()
EXP_OUT = "counterparty_expansion_rate counterparty_novelty_slope total_unique_counterparties".split()
AMT_OUT = "benford_deviation structuring_score round_amount_ratio amount_skewness amount_kurtosis".split()

ORACLES = {
    "b01_entropy": with_views(""",
c AS (SELECT customer_id, method, count(*) AS n FROM tx_orders GROUP BY 1, 2),
t AS (SELECT customer_id, n, sum(n) OVER (PARTITION BY customer_id) AS tot FROM c)
SELECT customer_id, round(-sum((n / tot) * log2(n / tot)), 6) AS method_entropy FROM t GROUP BY 1
"""),
    "b04_entropies": with_views(f""",{ent_cte('tx_events', 'customer_id', 'e_')}
SELECT customer_id, round(amount_entropy, 6) AS amount_entropy, round(timing_entropy, 6) AS timing_entropy,
       round(counterparty_entropy, 6) AS counterparty_entropy FROM e_ents
"""),
    "b06_entropy_drift": with_views("," + drift_cte("tx_orders", ORDERS_WINDOW_DAYS) + "\n"
                                    + sel_round(ENT_OUT, "dr_out") + ", num_windows FROM dr_out".replace(" FROM dr_out, num_windows", ", num_windows")),
    "b06_entropy_drift_events": with_views("," + drift_cte("tx_events", EVENTS_WINDOW_DAYS) + "\n"
                                           + sel_round(ENT_OUT + ["num_windows"], "dr_out", ints={"num_windows"})),
    "b07_temporal_burst": with_views("," + burst_cte("tx_events") + "\n" + sel_round(BURST_OUT, "bu_out", INT_SIGNALS)),
    "b07_temporal_burst_orders": with_views("," + burst_cte("tx_orders") + "\n" + sel_round(BURST_OUT, "bu_out", INT_SIGNALS)),
    "b08_counterparty_expansion": with_views("," + expansion_cte("tx_orders", ORDERS_WINDOW_DAYS) + "\n"
                                             + sel_round(EXP_OUT, "ex_out", INT_SIGNALS)),
    "b08_counterparty_expansion_events": with_views("," + expansion_cte("tx_events", EVENTS_WINDOW_DAYS) + "\n"
                                                    + sel_round(EXP_OUT, "ex_out", INT_SIGNALS)),
    "b13_amount_anomaly": with_views("," + amount_cte("tx_orders") + "\n" + sel_round(AMT_OUT, "am_out")),
    "b14_all_signals": with_views(""",
tx_known AS (SELECT * FROM tx_orders WHERE customer_id IN (SELECT customer_id FROM customers_v)),"""
                                  + all_signals_cte("tx_known", ORDERS_WINDOW_DAYS) + "\n"
                                  + sel_round(SIGNAL_COLS_SQL, "sg_out", INT_SIGNALS)),
}
ORACLES["b06_entropy_drift"] = with_views("," + drift_cte("tx_orders", ORDERS_WINDOW_DAYS) + "\n"
                                          + sel_round(ENT_OUT + ["num_windows"], "dr_out", ints={"num_windows"}))

"""Registered linkage (L01–L10) and rates (R01–R07) queries with oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions import dims
from driftwatch.operators import linkage as L
from driftwatch.operators import rates as R
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.stages import view as V
from driftwatch.sources import tables as TB

DAY = 86400000000


def _links(spark, sf):
    return L.link_fiat_to_crypto(V(spark, sf, "tx_orders"))


def _resolved(spark, sf):
    inf = _links(spark, sf)
    return L.resolve_links(inf, L.known_links_fixture(inf))


def _chain(spark, sf):
    ch = TB.chain_hops(spark, sf, V(spark, sf, "tx_orders"))
    return ch, L.wallets_fixture(ch)


def q_l01_purchases_deposits(spark, sf):
    prep(spark)
    p, d = L.purchases_and_deposits(V(spark, sf, "tx_orders"))
    return (p.groupBy("customer_id").agg(F.count("*").alias("purchases"))
            .join(d.groupBy("customer_id").agg(F.count("*").alias("deposits")), "customer_id", "full")
            .fillna(0))


def q_l02_link_fiat_to_crypto(spark, sf):
    prep(spark)
    return rounded(_links(spark, sf))


def q_l04_resolved_links(spark, sf):
    prep(spark)
    return rounded(_resolved(spark, sf))


def q_l05_chain_summary(spark, sf):
    prep(spark)
    ch, w = _chain(spark, sf)
    return rounded(L.chain_summary(ch, w))


def q_l06_flow_summary(spark, sf):
    prep(spark)
    ch, w = _chain(spark, sf)
    return rounded(L.flow_summary(_resolved(spark, sf), L.chain_summary(ch, w)))


def q_l07_source_of_funds(spark, sf):
    prep(spark)
    return L.source_of_funds_text(L.flow_summary(_resolved(spark, sf)))


def q_l08_wallet_totals(spark, sf):
    prep(spark)
    ch, w = _chain(spark, sf)
    return rounded(L.wallet_totals(ch, w))


def q_l10_exchange_risk(spark, sf):
    prep(spark)
    ex = V(spark, sf, "tx_orders").filter(F.col("method") == "crypto_exchange").select(
        F.col("location").alias("exchange")).distinct()
    return L.exchange_risk(ex)


def q_r01_densify_rates(spark, sf):
    prep(spark)
    return rounded(R.densify_rates(TB.rates_sparse(spark, sf, V(spark, sf, "tx_orders"))))


def q_r02_static_rates(spark, sf):
    """R02 over the calendar span of tx_orders (bounds stay in the plan)."""
    prep(spark)
    span = V(spark, sf, "tx_orders").agg(F.timestamp_micros(F.min("ts_us")).cast("date").alias("lo"),
                                       F.timestamp_micros(F.max("ts_us")).cast("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    cur = spark.createDataFrame([(k, float(v)) for k, v in R.STATIC.items()], "currency string, usd_rate double")
    return days.crossJoin(F.broadcast(cur)).withColumn("date", F.col("date").cast("string"))


def q_r03_rate_as_of(spark, sf):
    prep(spark)
    t = V(spark, sf, "tx_orders").select("transaction_id", "transaction_date", "currency", "amount")
    r = R.rate_as_of(t, TB.rates_sparse(spark, sf, V(spark, sf, "tx_orders")))
    return rounded(r.select("transaction_id", "currency", "usd_rate_asof",
                            R.to_usd(F.col("amount"), F.col("usd_rate_asof")).alias("usd_value")))


def q_r06_country_dims(spark, sf):
    prep(spark)
    c = V(spark, sf, "tx_orders").select("country").distinct()
    return c.select("country", R.currency_for_country(F.col("country")).alias("currency"),
                    R.price_level(F.col("country")).alias("price_level"))


def q_r07_cache_covers(spark, sf):
    prep(spark)
    return R.cache_covers(TB.rates_sparse(spark, sf, V(spark, sf, "tx_orders")), "1995-01-01", "2001-12-31") \
        .select("covers", F.col("first_date").cast("string").alias("first_date"),
                F.col("last_date").cast("string").alias("last_date"))


QUERIES = {
    "l01_purchases_deposits": q_l01_purchases_deposits,
    "l02_link_fiat_to_crypto": q_l02_link_fiat_to_crypto,
    "l04_resolved_links": q_l04_resolved_links,
    "l05_chain_summary": q_l05_chain_summary,
    "l06_flow_summary": q_l06_flow_summary,
    "l07_source_of_funds": q_l07_source_of_funds,
    "l08_wallet_totals": q_l08_wallet_totals,
    "l10_exchange_risk": q_l10_exchange_risk,
    "r01_densify_rates": q_r01_densify_rates,
    "r02_static_rates": q_r02_static_rates,
    "r03_rate_as_of": q_r03_rate_as_of,
    "r06_country_dims": q_r06_country_dims,
    "r07_cache_covers": q_r07_cache_covers,
}

# ----------------------------------------------------------------- DuckDB side
_BASE = {**{k: v for k, v in dims.FX_RATES.items() if k != "USD"}, **dims.CRYPTO_RATES_USD}
_BASE_VALUES = ", ".join(f"('{k}', CAST({float(v)} AS DOUBLE))" for k, v in _BASE.items())
_STATIC_ALL = {**dims.FX_RATES, **dims.CRYPTO_RATES_USD}
_STATIC_CASE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in _STATIC_ALL.items()) + " END"
_RISK = {k: v[0] for k, v in dims.EXCHANGE_PROFILES.items()}


def _case(expr, m, default="NULL"):
    w = " ".join(f"WHEN '{k}' THEN {'CAST(' + repr(float(v)) + ' AS DOUBLE)' if not isinstance(v, str) else chr(39) + v + chr(39)}" for k, v in m.items())
    return f"(CASE {expr} {w} ELSE {default} END)"


RATES_CTE = f"""
rs_span AS (SELECT CAST(make_timestamp(min(ts_us)) AS DATE) AS lo, CAST(make_timestamp(max(ts_us)) AS DATE) AS hi FROM tx_orders),
rs_days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM rs_span),
rs_cur AS (SELECT * FROM (VALUES {_BASE_VALUES}) v(currency, base)),
rates_sparse AS (
  SELECT d.date, c.currency, round(c.base * (1 + ((dayofyear(d.date) * 7) % 11 - 5) / 1000.0), 8) AS usd_rate
  FROM rs_days d CROSS JOIN rs_cur c WHERE isodow(d.date) NOT IN (6, 7)
)"""

LINKS_CTE = f"""
lk_p AS (SELECT * FROM tx_orders WHERE method = 'crypto_exchange' AND transaction_type = 'withdrawal'),
lk_d AS (SELECT * FROM tx_orders WHERE transaction_type = 'deposit' AND method <> 'crypto_exchange'),
lk_c AS (
  SELECT p.transaction_id AS pid, arg_max(d.transaction_id, (d.ts_us, d.transaction_id)) AS did
  FROM lk_p p JOIN lk_d d ON p.customer_id = d.customer_id AND d.ts_us >= p.ts_us - {10 * DAY} AND d.ts_us < p.ts_us
  GROUP BY p.transaction_id
),
links AS (
  SELECT p.customer_id, p.transaction_id AS crypto_txn_id,
    strftime(make_timestamp(p.ts_us), '%Y-%m-%d') AS crypto_date, p.crypto_asset, p.amount AS crypto_amount,
    round(p.amount * coalesce(p.usd_rate, 1.0), 2) AS crypto_usd, p.location AS exchange,
    d.transaction_id AS fiat_txn_id, strftime(make_timestamp(d.ts_us), '%Y-%m-%d') AS fiat_date,
    round(d.amount, 2) AS fiat_amount, d.currency AS fiat_currency,
    round(d.amount * coalesce(d.usd_rate, 1.0), 2) AS fiat_usd, d.country AS fiat_source_country,
    d.counterparty AS fiat_counterparty,
    CASE WHEN d.transaction_id IS NULL THEN 'UNLINKED'
         WHEN abs(d.amount * coalesce(d.usd_rate, 1.0) - p.amount * coalesce(p.usd_rate, 1.0)) / greatest(p.amount * coalesce(p.usd_rate, 1.0), 1) <= {dims.LINK_HIGH_MAX_DEV} THEN 'HIGH'
         WHEN abs(d.amount * coalesce(d.usd_rate, 1.0) - p.amount * coalesce(p.usd_rate, 1.0)) / greatest(p.amount * coalesce(p.usd_rate, 1.0), 1) <= {dims.LINK_MEDIUM_MAX_DEV} THEN 'MEDIUM'
         ELSE 'LOW' END AS confidence,
    CAST(floor((p.ts_us - d.ts_us) / {DAY}) AS BIGINT) AS days_before,
    round(abs(d.amount * coalesce(d.usd_rate, 1.0) - p.amount * coalesce(p.usd_rate, 1.0)) / greatest(p.amount * coalesce(p.usd_rate, 1.0), 1), 3) AS amount_deviation
  FROM lk_p p LEFT JOIN lk_c c ON p.transaction_id = c.pid LEFT JOIN lk_d d ON d.transaction_id = c.did
),
known AS (
  SELECT customer_id, CAST(NULL AS VARCHAR) AS crypto_txn_id, crypto_date, crypto_asset, crypto_amount,
    fiat_usd AS crypto_usd, exchange, CAST(NULL AS VARCHAR) AS fiat_txn_id, fiat_date, fiat_amount, fiat_currency,
    fiat_usd, fiat_source_country, fiat_counterparty, 'EXACT' AS confidence, CAST(NULL AS BIGINT) AS days_before,
    0.0::DOUBLE AS amount_deviation
  FROM links WHERE customer_id % 10 = 0 AND confidence <> 'UNLINKED'
),
resolved AS (
  SELECT * FROM known
  UNION ALL
  SELECT * FROM links WHERE customer_id NOT IN (SELECT customer_id FROM known)
)"""

LINK_COLS = ("customer_id, crypto_txn_id, crypto_date, crypto_asset, round(crypto_amount, 6) AS crypto_amount, "
             "round(crypto_usd, 6) AS crypto_usd, exchange, fiat_txn_id, fiat_date, round(fiat_amount, 6) AS fiat_amount, "
             "fiat_currency, round(fiat_usd, 6) AS fiat_usd, fiat_source_country, fiat_counterparty, confidence, "
             "days_before, round(amount_deviation, 6) AS amount_deviation")

CHAIN_CTE = f"""
ch AS (
  SELECT 'c-' || transaction_id AS chain_txn_id, customer_id, 'w' || CAST(src_suppkey AS VARCHAR) AS from_address,
    'w' || CAST(src_partkey % 50 AS VARCHAR) AS to_address, crypto_asset AS asset, amount,
    round(amount * 0.999, 8) AS net_amount, round(amount * 0.001, 8) AS fee_amount, ts_us,
    src_linenumber AS hop_number,
    (['direct', 'layered', 'mixer', 'peel_chain'])[(src_partkey % 4) + 1] AS pattern_type,
    (src_partkey % 4 = 2) AS is_mixer, (src_linenumber = 1) AS is_cashout, location AS exchange
  FROM tx_orders WHERE method = 'crypto_exchange'
),
ch_ends AS (
  SELECT customer_id, from_address AS address, asset, exchange, hop_number = 1 AS e, false AS c FROM ch
  UNION ALL
  SELECT customer_id, to_address, asset, exchange, false, is_cashout FROM ch
),
wal AS (
  SELECT customer_id, address, min(asset) AS asset, bool_or(e) AS is_entry_point, bool_or(c) AS is_cashout_point,
         min(exchange) AS ex
  FROM ch_ends GROUP BY 1, 2
),
wallets AS (
  SELECT CAST(customer_id AS VARCHAR) || ':' || address AS wallet_id, customer_id, address, asset,
    CASE WHEN is_entry_point OR is_cashout_point THEN 'exchange_hot_wallet' ELSE 'private' END AS entity_type,
    CASE WHEN is_entry_point OR is_cashout_point THEN ex END AS exchange_name,
    CASE WHEN is_entry_point OR is_cashout_point THEN coalesce({_case('ex', _RISK)}, 0.0) ELSE 0.0 END AS risk_score,
    is_entry_point, is_cashout_point
  FROM wal
),
ch_nw AS (SELECT customer_id, count(DISTINCT a) AS unique_wallets FROM
          (SELECT customer_id, from_address AS a FROM ch UNION ALL SELECT customer_id, to_address FROM ch) GROUP BY 1),
ch_h AS (
  SELECT customer_id, count(*) AS total_hops, list_sort(list_distinct(list(pattern_type))) AS patterns_used,
    count(*) FILTER (WHERE is_mixer) AS mixer_hops, count(*) FILTER (WHERE is_cashout) AS cashout_hops,
    round(sum(fee_amount), 8) AS total_fees_crypto
  FROM ch GROUP BY 1
),
ch_ex AS (
  SELECT customer_id,
    list_sort(list_distinct(list(exchange_name) FILTER (WHERE is_entry_point))) AS entry_exchanges,
    list_sort(list_distinct(list(exchange_name) FILTER (WHERE is_cashout_point))) AS cashout_exchanges,
    list_sort(list_distinct(list(exchange_name) FILTER (WHERE (is_entry_point OR is_cashout_point)
              AND coalesce({_case('exchange_name', _RISK)}, 0.0) >= {dims.HIGH_RISK_EXCHANGE_MIN}))) AS high_risk_exchanges
  FROM wallets WHERE exchange_name IS NOT NULL GROUP BY 1
),
chain_sum AS (
  SELECT h.customer_id, CAST(total_hops AS BIGINT) AS total_hops, CAST(unique_wallets AS BIGINT) AS unique_wallets,
    patterns_used, CAST(mixer_hops AS BIGINT) AS mixer_hops, CAST(cashout_hops AS BIGINT) AS cashout_hops,
    total_fees_crypto,
    coalesce(entry_exchanges, []) AS entry_exchanges, coalesce(cashout_exchanges, []) AS cashout_exchanges,
    coalesce(high_risk_exchanges, []) AS high_risk_exchanges
  FROM ch_h h JOIN ch_nw USING (customer_id) LEFT JOIN ch_ex USING (customer_id)
)"""

ORACLES = {
    "l01_purchases_deposits": with_views(""",
p AS (SELECT customer_id, count(*) AS purchases FROM tx_orders WHERE method = 'crypto_exchange' AND transaction_type = 'withdrawal' GROUP BY 1),
d AS (SELECT customer_id, count(*) AS deposits FROM tx_orders WHERE transaction_type = 'deposit' AND method <> 'crypto_exchange' GROUP BY 1)
SELECT coalesce(p.customer_id, d.customer_id) AS customer_id, CAST(coalesce(purchases, 0) AS BIGINT) AS purchases,
       CAST(coalesce(deposits, 0) AS BIGINT) AS deposits
FROM p FULL JOIN d ON p.customer_id = d.customer_id
"""),
    "l02_link_fiat_to_crypto": with_views("," + LINKS_CTE + f"\nSELECT {LINK_COLS} FROM links"),
    "l04_resolved_links": with_views("," + LINKS_CTE + f"\nSELECT {LINK_COLS} FROM resolved"),
    "l05_chain_summary": with_views("," + CHAIN_CTE + """
SELECT customer_id, total_hops, unique_wallets, patterns_used, mixer_hops, cashout_hops,
       round(total_fees_crypto, 6) AS total_fees_crypto, entry_exchanges, cashout_exchanges, high_risk_exchanges
FROM chain_sum
"""),
    "l06_flow_summary": with_views("," + LINKS_CTE + "," + CHAIN_CTE + """,
fs AS (
  SELECT customer_id,
    CAST(count(*) FILTER (WHERE confidence <> 'UNLINKED') AS BIGINT) AS linked,
    CAST(count(*) FILTER (WHERE confidence = 'UNLINKED') AS BIGINT) AS unlinked,
    CAST(count(*) FILTER (WHERE confidence = 'EXACT') AS BIGINT) AS n_exact,
    CAST(count(*) FILTER (WHERE confidence = 'HIGH') AS BIGINT) AS n_high,
    CAST(count(*) FILTER (WHERE confidence = 'MEDIUM') AS BIGINT) AS n_medium,
    CAST(count(*) FILTER (WHERE confidence = 'LOW') AS BIGINT) AS n_low,
    sum(crypto_usd) AS crypto_usd_total,
    sum(fiat_usd) FILTER (WHERE confidence <> 'UNLINKED') AS fiat_usd_total,
    coalesce(list_sort(list_distinct(list(fiat_source_country) FILTER (WHERE confidence <> 'UNLINKED'))), []) AS source_countries,
    coalesce(list_sort(list_distinct(list(fiat_currency) FILTER (WHERE confidence <> 'UNLINKED'))), []) AS fiat_currencies,
    coalesce(list_sort(list_distinct(list(fiat_counterparty) FILTER (WHERE confidence <> 'UNLINKED' AND fiat_counterparty IS NOT NULL AND fiat_counterparty <> ''))), []) AS cps,
    arg_max(fiat_source_country, fiat_usd) FILTER (WHERE confidence <> 'UNLINKED') AS top_source_country
  FROM resolved GROUP BY 1
)
SELECT fs.customer_id, linked, unlinked, n_exact, n_high, n_medium, n_low,
  round(crypto_usd_total, 6) AS crypto_usd_total, round(fiat_usd_total, 6) AS fiat_usd_total,
  source_countries, fiat_currencies, top_source_country, cps[1:4] AS counterparties,
  coalesce(cs.entry_exchanges <> cs.cashout_exchanges, false) AS entry_differs_from_exit
FROM fs LEFT JOIN chain_sum cs USING (customer_id)
"""),
    "l08_wallet_totals": with_views("," + CHAIN_CTE + """,
rec AS (SELECT customer_id, to_address AS address, sum(net_amount) AS total_received FROM ch GROUP BY 1, 2),
snt AS (SELECT customer_id, from_address AS address, sum(amount) AS total_sent FROM ch GROUP BY 1, 2),
seen AS (SELECT customer_id, address, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us FROM
         (SELECT customer_id, from_address AS address, ts_us FROM ch UNION ALL SELECT customer_id, to_address, ts_us FROM ch)
         GROUP BY 1, 2)
SELECT w.wallet_id, w.customer_id, w.address, w.asset, w.entity_type, w.exchange_name, round(w.risk_score, 6) AS risk_score,
  w.is_entry_point, w.is_cashout_point, round(coalesce(total_received, 0), 6) AS total_received,
  round(coalesce(total_sent, 0), 6) AS total_sent, first_seen_us, last_seen_us
FROM wallets w LEFT JOIN rec USING (customer_id, address) LEFT JOIN snt USING (customer_id, address)
LEFT JOIN seen USING (customer_id, address)
"""),
    "l10_exchange_risk": with_views(f""",
ex AS (SELECT DISTINCT location AS exchange FROM tx_orders WHERE method = 'crypto_exchange')
SELECT exchange, {_case('exchange', _RISK)} AS exchange_risk,
  {_case('exchange', {k: v[1] for k, v in dims.EXCHANGE_PROFILES.items()})} AS kyc_level,
  {_case('exchange', {k: v[2] for k, v in dims.EXCHANGE_PROFILES.items()})} AS jurisdiction,
  CASE WHEN {_case('exchange', _RISK)} >= {dims.HIGH_RISK_EXCHANGE_MIN} THEN 'high'
       WHEN {_case('exchange', _RISK)} < {dims.LOW_RISK_EXCHANGE_MAX} THEN 'low'
       WHEN {_case('exchange', _RISK)} IS NOT NULL THEN 'medium' END AS risk_band
FROM ex
"""),
    "r01_densify_rates": with_views("," + RATES_CTE + """,
span AS (SELECT min(date) AS lo, max(date) AS hi FROM rates_sparse),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
cur AS (SELECT DISTINCT currency FROM rates_sparse WHERE currency <> 'USD'),
g AS (SELECT d.date, c.currency, r.usd_rate FROM days d CROSS JOIN cur c
      LEFT JOIN rates_sparse r ON r.date = d.date AND r.currency = c.currency),
f AS (SELECT date, currency, coalesce(
        last_value(usd_rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(usd_rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS usd_rate
      FROM g)
SELECT date, currency, round(usd_rate, 6) AS usd_rate FROM f
UNION ALL SELECT date, 'USD', 1.0 FROM days
"""),
    "r02_static_rates": with_views("," + RATES_CTE + f""",
st AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({float(v)} AS DOUBLE))" for k, v in _STATIC_ALL.items())}) v(currency, usd_rate))
SELECT CAST(d.date AS VARCHAR) AS date, st.currency, st.usd_rate FROM rs_days d CROSS JOIN st
"""),
    "r03_rate_as_of": with_views("," + RATES_CTE + f""",
t AS (SELECT transaction_id, currency, amount, CAST(make_timestamp(ts_us) AS DATE) AS d FROM tx_orders),
j AS (SELECT t.*, r.usd_rate AS r FROM t ASOF LEFT JOIN rates_sparse r ON t.currency = r.currency AND t.d >= r.date)
SELECT transaction_id, currency,
  round(CASE WHEN currency = 'USD' THEN 1.0 ELSE coalesce(r, {_STATIC_CASE.format(c='currency')}, 1.0) END, 6) AS usd_rate_asof,
  round(round(amount * CASE WHEN currency = 'USD' THEN 1.0 ELSE coalesce(r, {_STATIC_CASE.format(c='currency')}, 1.0) END, 6 + 0), 6) AS usd_value
FROM j
"""),
    "r06_country_dims": with_views(f""",
c AS (SELECT DISTINCT country FROM tx_orders)
SELECT country, coalesce({_case('country', dims.COUNTRY_CURRENCY_MAP)}, 'USD') AS currency,
       coalesce({_case('country', {k: float(v) for k, v in dims.COUNTRY_PPL.items()})}, CAST({dims.DEFAULT_PPL} AS DOUBLE)) AS price_level
FROM c
"""),
    "r07_cache_covers": with_views("," + RATES_CTE + """
SELECT (min(date) <= DATE '1995-01-01' AND max(date) >= DATE '2001-12-31') AS covers,
       CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM rates_sparse
"""),
}

"""Registered alert / investigation queries (A01–A14) with oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions import dims
from driftwatch.operators import alerts as A
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.stages import view as V
from driftwatch.sources import tables as TB


def _alerts(spark, sf):
    return A.create_alerts(V(spark, sf, "customers_v"), V(spark, sf, "tx_orders"))


def q_a01_create_alerts(spark, sf):
    prep(spark)
    return rounded(_alerts(spark, sf).drop("alert_date"))


def q_a02_alert_transactions(spark, sf):
    prep(spark)
    t = A.alert_transactions(_alerts(spark, sf), V(spark, sf, "tx_orders"), method="wire", limit=5)
    return rounded(t.select("alert_id", "transaction_id", "ts_us", "transaction_type", "amount", "currency",
                            "method", "country", "counterparty", "rank", "usd_amount"))


def q_a03_alert_transactions_ci(spark, sf):
    prep(spark)
    t = A.alert_transactions(_alerts(spark, sf), V(spark, sf, "tx_orders"), country="usa", txn_type="DEPOSIT",
                             min_amount=0, max_amount=50000, counterparty="supplier#00000001",
                             start_date="1996-01-01", end_date="2000-12-31", case_insensitive=True, limit=200)
    return rounded(t.select("alert_id", "transaction_id", "ts_us", "amount", "counterparty", "rank", "usd_amount"))


def q_a05_counterparty_profile(spark, sf):
    prep(spark)
    return rounded(A.counterparty_profile(_alerts(spark, sf), V(spark, sf, "tx_orders")))


def q_a06_timeline_slice(spark, sf):
    prep(spark)
    start = 852076800000000  # 1997-01-01
    end = 915148799000000    # 1998-12-31 23:59:59
    return rounded(A.timeline_slice(_alerts(spark, sf), V(spark, sf, "tx_orders"), start, end))


def q_a07_transaction_summary(spark, sf):
    prep(spark)
    s = A.transaction_summary(_alerts(spark, sf), V(spark, sf, "tx_orders"))
    return rounded(s.withColumn("first_date", F.col("first_date").cast("string"))
                   .withColumn("last_date", F.col("last_date").cast("string")))


def q_a08_breakdown(spark, sf):
    prep(spark)
    return rounded(A.breakdown(_alerts(spark, sf), V(spark, sf, "tx_orders")))


def q_a09_prior_alerts(spark, sf):
    prep(spark)
    # every customer's events as alerts: several alerts per customer
    return rounded(A.prior_alerts(_alerts(spark, sf).unionByName(
        _alerts(spark, sf).withColumn("alert_id", F.col("alert_id") + 100000)
        .withColumn("alert_date_us", F.col("alert_date_us") - 86400000000)))
        .select("alert_id", "customer_id", "prior_alert_id", "alert_type", "severity", "total_amount", "position"))


def q_a10_alert_record(spark, sf):
    prep(spark)
    r = A.alert_record(_alerts(spark, sf), V(spark, sf, "customers_v"), V(spark, sf, "tx_orders"))
    return rounded(r.drop("alert_date").withColumn("account_open_date", F.col("account_open_date").cast("string")))


def q_a11_alert_list(spark, sf):
    prep(spark)
    return rounded(A.alert_list(_alerts(spark, sf), V(spark, sf, "customers_v")).drop("alert_date"))


def q_a13_transaction_lines(spark, sf):
    prep(spark)
    return A.transaction_lines(_alerts(spark, sf), V(spark, sf, "tx_orders"), limit=20)


def q_a14_case_header(spark, sf):
    prep(spark)
    h = A.case_header(_alerts(spark, sf), V(spark, sf, "customers_v"), V(spark, sf, "tx_orders"))
    return h.select("alert_id", "customer_id", "name", "total_transactions", "net_flow_usd",
                    F.size("breakdown").alias("breakdown_rows"), "prior_alert_count")


QUERIES = {
    "a01_create_alerts": q_a01_create_alerts,
    "a02_alert_transactions": q_a02_alert_transactions,
    "a03_alert_transactions_ci": q_a03_alert_transactions_ci,
    "a05_counterparty_profile": q_a05_counterparty_profile,
    "a06_timeline_slice": q_a06_timeline_slice,
    "a07_transaction_summary": q_a07_transaction_summary,
    "a08_breakdown": q_a08_breakdown,
    "a09_prior_alerts": q_a09_prior_alerts,
    "a10_alert_record": q_a10_alert_record,
    "a11_alert_list": q_a11_alert_list,
    "a13_transaction_lines": q_a13_transaction_lines,
    "a14_case_header": q_a14_case_header,
}

# ----------------------------------------------------------------- DuckDB side
H8 = "('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT"
HG = "('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '|gray'), 1, 8))::BIGINT"
PROF = "CASE gray_profile " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.GRAY_PROFILE_TO_TYPOLOGY.items()) + " ELSE 'structuring' END"
ANALYSTS = "[" + ", ".join(f"'{a}'" for a in A.ANALYSTS) + "]"

ALERTS_CTE = f"""
al_c AS (
  SELECT customer_id, CASE WHEN is_suspicious THEN 0 ELSE 1 END AS grp,
    CASE WHEN is_suspicious THEN coalesce(typology, 'structuring') ELSE {PROF} END AS alert_type,
    CASE WHEN is_suspicious THEN (CASE WHEN {H8} % 10 < 8 THEN 'high' ELSE 'medium' END)
         ELSE (CASE WHEN {H8} % 10 < 2 THEN 'high' WHEN {H8} % 10 < 7 THEN 'medium' ELSE 'low' END) END AS severity,
    ({ANALYSTS})[({H8} % {len(A.ANALYSTS)}) + 1] AS assigned_analyst
  FROM customers_v
  WHERE is_suspicious OR (is_gray_area AND NOT is_suspicious AND {HG} % 1000 < {int(dims.GRAY_ALERT_SHARE * 1000)})
),
al_agg AS (SELECT customer_id, max(ts_us) AS last_us, sum(amount) AS tot, count(*) AS n, avg(amount) AS av
           FROM tx_orders GROUP BY 1),
alerts AS (
  SELECT CAST(row_number() OVER (ORDER BY grp, customer_id) - 1 AS BIGINT) AS alert_id, customer_id,
    last_us AS alert_date_us, alert_type, severity, round(tot, 2) AS total_amount, CAST(n AS BIGINT) AS num_transactions,
    round(av, 2) AS avg_transaction_amount, 'open' AS status, assigned_analyst, false AS sar_filed
  FROM al_c JOIN al_agg USING (customer_id)
)"""

A_COLS = ("alert_id, customer_id, alert_date_us, alert_type, severity, round(total_amount, 6) AS total_amount, "
          "num_transactions, round(avg_transaction_amount, 6) AS avg_transaction_amount, status, assigned_analyst, sar_filed")

ORACLES = {
    "a01_create_alerts": with_views("," + ALERTS_CTE + f"\nSELECT {A_COLS} FROM alerts"),
    "a02_alert_transactions": with_views("," + ALERTS_CTE + """,
j AS (SELECT a.alert_id, t.*, row_number() OVER (PARTITION BY a.alert_id ORDER BY t.ts_us DESC, t.transaction_id DESC) AS rank
      FROM alerts a JOIN tx_orders t USING (customer_id) WHERE t.method = 'wire')
SELECT alert_id, transaction_id, ts_us, transaction_type, round(amount, 6) AS amount, currency, method, country,
       counterparty, CAST(rank AS INTEGER) AS rank, round(round(amount * coalesce(usd_rate, 1.0), 2), 6) AS usd_amount
FROM j WHERE rank <= 5
"""),
    "a03_alert_transactions_ci": with_views("," + ALERTS_CTE + """,
j AS (SELECT a.alert_id, t.*, row_number() OVER (PARTITION BY a.alert_id ORDER BY t.ts_us DESC, t.transaction_id DESC) AS rank
      FROM alerts a JOIN tx_orders t USING (customer_id)
      WHERE lower(t.country) = lower('usa') AND lower(t.transaction_type) = lower('DEPOSIT') AND t.amount <= 50000
        AND t.transaction_date >= TIMESTAMP '1996-01-01' AND t.transaction_date <= TIMESTAMP '2000-12-31'
        AND contains(lower(t.counterparty), 'supplier#00000001'))
SELECT alert_id, transaction_id, ts_us, round(amount, 6) AS amount, counterparty, CAST(rank AS INTEGER) AS rank,
       round(round(amount * coalesce(usd_rate, 1.0), 2), 6) AS usd_amount
FROM j WHERE rank <= 200
"""),
    "a05_counterparty_profile": with_views("," + ALERTS_CTE + """
SELECT a.alert_id, t.counterparty, CAST(count(*) AS BIGINT) AS txn_count,
       round(sum(t.amount * coalesce(t.usd_rate, 1.0)), 6) AS usd_total,
       CAST(count(*) FILTER (WHERE t.transaction_type = 'deposit') AS BIGINT) AS deposits,
       CAST(count(*) FILTER (WHERE t.transaction_type = 'withdrawal') AS BIGINT) AS withdrawals
FROM alerts a JOIN tx_orders t USING (customer_id) WHERE t.counterparty IS NOT NULL GROUP BY 1, 2
"""),
    "a06_timeline_slice": with_views("," + ALERTS_CTE + """
SELECT a.alert_id, CAST(count(*) AS BIGINT) AS txn_count, round(sum(t.amount * coalesce(t.usd_rate, 1.0)), 6) AS usd_total,
       min(t.ts_us) AS first_us, max(t.ts_us) AS last_us
FROM alerts a JOIN tx_orders t USING (customer_id)
WHERE t.ts_us >= 852076800000000 AND t.ts_us <= 915148799000000 GROUP BY 1
"""),
    "a07_transaction_summary": with_views("," + ALERTS_CTE + """,
s AS (
  SELECT a.alert_id, count(*) AS total_transactions,
    count(*) FILTER (WHERE transaction_type = 'deposit') AS num_deposits,
    count(*) FILTER (WHERE transaction_type = 'withdrawal') AS num_withdrawals,
    coalesce(sum(amount * coalesce(usd_rate, 1.0)) FILTER (WHERE transaction_type = 'deposit'), 0) AS dep,
    coalesce(sum(amount * coalesce(usd_rate, 1.0)) FILTER (WHERE transaction_type = 'withdrawal'), 0) AS wd,
    min(ts_us) AS first_us, max(ts_us) AS last_us
  FROM alerts a JOIN tx_orders t USING (customer_id) GROUP BY 1
)
SELECT alert_id, CAST(total_transactions AS BIGINT) AS total_transactions, CAST(num_deposits AS BIGINT) AS num_deposits,
  CAST(num_withdrawals AS BIGINT) AS num_withdrawals, round(dep, 6) AS deposits_usd, round(wd, 6) AS withdrawals_usd,
  first_us, last_us, round(dep - wd, 6) AS net_flow_usd,
  CAST(CAST(make_timestamp(first_us) AS DATE) AS VARCHAR) AS first_date,
  CAST(CAST(make_timestamp(last_us) AS DATE) AS VARCHAR) AS last_date
FROM s
"""),
    "a08_breakdown": with_views("," + ALERTS_CTE + """,
j AS (SELECT a.alert_id, t.country, t.method, strftime(make_timestamp(t.ts_us), '%Y-%m') AS month, t.currency,
             t.amount * coalesce(t.usd_rate, 1.0) AS usd
      FROM alerts a JOIN tx_orders t USING (customer_id))
SELECT alert_id, 'country' AS dimension, country AS value, CAST(count(*) AS BIGINT) AS txn_count, round(sum(usd), 6) AS usd_total FROM j GROUP BY 1, 3
UNION ALL SELECT alert_id, 'method', method, CAST(count(*) AS BIGINT), round(sum(usd), 6) FROM j GROUP BY 1, 3
UNION ALL SELECT alert_id, 'month', month, CAST(count(*) AS BIGINT), round(sum(usd), 6) FROM j GROUP BY 1, 3
UNION ALL SELECT alert_id, 'currency', currency, CAST(count(*) AS BIGINT), round(sum(usd), 6) FROM j GROUP BY 1, 3
"""),
    "a09_prior_alerts": with_views("," + ALERTS_CTE + """,
al2 AS (SELECT * FROM alerts UNION ALL
        SELECT * REPLACE (alert_id + 100000 AS alert_id, alert_date_us - 86400000000 AS alert_date_us) FROM alerts),
j AS (SELECT a.alert_id, a.customer_id, b.alert_id AS prior_alert_id, b.alert_type, b.severity, b.total_amount,
             row_number() OVER (PARTITION BY a.alert_id ORDER BY b.alert_date_us DESC, b.alert_id DESC) AS position
      FROM al2 a JOIN al2 b ON a.customer_id = b.customer_id AND a.alert_id <> b.alert_id)
SELECT alert_id, customer_id, prior_alert_id, alert_type, severity, round(total_amount, 6) AS total_amount,
       CAST(position AS INTEGER) AS position FROM j
"""),
    "a10_alert_record": with_views("," + ALERTS_CTE + f""",
n AS (SELECT customer_id, count(*) AS c FROM tx_orders GROUP BY 1)
SELECT a.customer_id, {A_COLS.replace('customer_id, ', '', 1)}, c.name, c.customer_type, round(c.annual_income, 6) AS annual_income,
       CAST(c.account_open_date AS VARCHAR) AS account_open_date, c.is_suspicious, c.typology, c.is_gray_area,
       c.gray_profile, c.country, CAST(coalesce(n.c, 0) AS BIGINT) AS customer_num_transactions
FROM alerts a JOIN customers_v c USING (customer_id) LEFT JOIN n USING (customer_id)
""".replace("SELECT a.customer_id, alert_id,", "SELECT a.customer_id, a.alert_id,")),
    "a11_alert_list": with_views("," + ALERTS_CTE + f"""
SELECT {A_COLS}, c.name FROM alerts a LEFT JOIN customers_v c USING (customer_id)
""".replace("SELECT alert_id, customer_id,", "SELECT alert_id, a.customer_id,")),
}


def q_a04_transaction_by_id(spark, sf):
    """Each alert asks for two ids — its customer's latest transaction
    and another customer's; only the first resolves."""
    prep(spark)
    a = _alerts(spark, sf)
    t = V(spark, sf, "tx_orders")
    latest = t.groupBy("customer_id").agg(F.max_by("transaction_id", "ts_us").alias("transaction_id"))
    own = a.join(latest, "customer_id").select("alert_id", "transaction_id")
    other = a.join(latest.withColumn("customer_id", F.col("customer_id") + 1), "customer_id") \
        .select("alert_id", "transaction_id")
    r = A.transaction_by_id(a, t, own.unionByName(other))
    return rounded(r.select("alert_id", "customer_id", "transaction_id", "amount", "currency", "usd_equivalent"))


def q_a12_behavioural_record(spark, sf):
    """Features ⟕ BSI ⟕ monitoring for every alerted customer."""
    from driftwatch.operators import stability as ST
    from driftwatch.plans.q_model import behavioural_stage, bsi_stage
    prep(spark)
    a = _alerts(spark, sf).select("customer_id")
    f = behavioural_stage(spark, sf).join(a, "customer_id", "left_semi")
    b = bsi_stage(spark, sf)
    m = ST.monitoring_state(b, "2025-12-31 00:00:00").drop("bsi_score", "drift_level", "timestamp")
    r = A.behavioural_record(f, b, m)
    return r.select("customer_id", F.col("bsi.bsi_score").alias("bsi_score"),
                    F.col("monitoring.monitoring_level").alias("monitoring_level"))


QUERIES["a04_transaction_by_id"] = q_a04_transaction_by_id
QUERIES["a12_behavioural_record"] = q_a12_behavioural_record
ORACLES["a04_transaction_by_id"] = with_views("," + ALERTS_CTE + """,
latest AS (SELECT customer_id, arg_max(transaction_id, ts_us) AS transaction_id FROM tx_orders GROUP BY 1)
SELECT a.alert_id, a.customer_id, t.transaction_id, round(t.amount, 6) AS amount, t.currency,
       round(round(t.amount * coalesce(t.usd_rate, 1.0), 2), 6) AS usd_equivalent
FROM alerts a JOIN latest l USING (customer_id) JOIN tx_orders t ON t.transaction_id = l.transaction_id
""")

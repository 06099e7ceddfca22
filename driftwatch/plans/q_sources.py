"""Registered loader / sampling / export / count queries.

External-format inputs are derived from the driver tables by Spark (so every
query's work grows with them): an AMLSim-style edge list from the account
transfers, PaySim / AMLNet-style event logs from ``events``, a SAML-D-style
edge list (with messy column names) from the order lines.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from driftwatch.functions.exprs import attach_scalars

from driftwatch.operators import alerts as A
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.q_alerts import _alerts
from driftwatch.plans.stages import view as V
from driftwatch.session import checkpoint_dir
from driftwatch.sources import loaders as LD
from driftwatch.sources import tables as TB

US_DAY = 86_400_000_000
EVENT_TYPE = {"view": "PAYMENT", "click": "CASH_IN", "signup": "TRANSFER", "purchase": "CASH_OUT", "error": "DEBIT"}


def _events_raw(spark, sf):
    e = TB.read_table(spark, sf, "events")
    mn = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_mn"))
    m = F.create_map(*[x for k, v in EVENT_TYPE.items() for x in (F.lit(k), F.lit(v))])
    return attach_scalars(e, mn).select(
        F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_mn")) / 3_600_000_000).cast("long").alias("step"),
        F.element_at(m, F.col("event_type")).alias("type"),
        F.round(F.col("value") * 100, 2).alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        F.concat(F.lit("M"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))).alias("nameDest"),
        (F.col("value") > 450).cast("int").alias("isFraud"),
        F.month("ts").alias("month"), F.dayofmonth("ts").alias("day_of_month"), F.hour("ts").alias("hour"),
        F.element_at(F.array(*[F.lit(c) for c in ["Shell Company", "Cryptocurrency", "Property Investment", "Other"]]),
                     (F.col("event_id") % 4 + 1).cast("int")).alias("category"),
        F.when(F.col("value") > 450, "layering").otherwise("normal").alias("laundering_typology"),
        (F.col("value") / 500.0).alias("fraud_probability"),
        (F.col("value") > 450).cast("int").alias("isMoneyLaundering"))


def q_s02_load_account_edges(spark, sf):
    prep(spark)
    t = TB.account_txns(spark, sf, V(spark, sf, "tx_orders"))
    mn = t.agg(F.min("ts_us").alias("_mn"))
    raw = attach_scalars(t, mn).select(
        F.col("customer_id").alias("sourceNodeId"), F.col("counterparty").cast("long").alias("targetNodeId"),
        F.col("amount").alias("value"), F.floor((F.col("ts_us") - F.col("_mn")) / (3 * US_DAY)).cast("int").alias("time"))
    nodes = V(spark, sf, "customers_v").select(F.col("customer_id").alias("nodeid"),
                                               F.col("is_suspicious").cast("int").alias("isFraud"))
    tx, fraud = LD.load_account_edges(nodes, raw)
    return rounded(tx.drop("transaction_date"))


def q_s03_load_paysim(spark, sf):
    prep(spark)
    tx, fraud = LD.load_paysim(_events_raw(spark, sf))
    return rounded(tx.drop("transaction_date"))


def q_s04_load_samld(spark, sf):
    prep(spark)
    t = V(spark, sf, "tx_orders")
    raw = t.select(F.col("customer_id").cast("string").alias(" from_id "), F.col("counterparty").alias("TARGET"),
                   F.col("amount").cast("string").alias("amount"),
                   F.when(F.col("src_partkey") % 7 == 0, F.lit("not a date"))
                   .when(F.col("src_partkey") % 7 == 1, (F.col("src_linenumber") * 3).cast("string"))
                   .otherwise(F.date_format("transaction_date", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
                   F.element_at(F.array(*[F.lit(x) for x in ["Wire", "ACH", "Cheque", "Cash", "Credit", "Bitcoin", "Other"]]),
                                (F.col("src_partkey") % 7 + 1).cast("int")).alias("Payment_Format"),
                   F.element_at(F.array(*[F.lit(x) for x in ["US Dollar", "Euro", "UAE Dirham", "Yen"]]),
                                (F.col("src_suppkey") % 4 + 1).cast("int")).alias("Sending_Currency"),
                   (F.col("src_price") >= 7000).cast("int").alias("label"))
    tx, fraud = LD.load_samld(raw)
    return rounded(tx.drop("transaction_date"))


def q_s05_load_amlnet(spark, sf):
    prep(spark)
    tx, fraud, typ = LD.load_amlnet(_events_raw(spark, sf))
    return rounded(tx.drop("transaction_date"))


def q_s06_counterparty_pool(spark, sf):
    prep(spark)
    t = V(spark, sf, "tx_orders").filter(F.col("counterparty").isNotNull()).select("transaction_id", "counterparty")
    return LD.remap_counterparty_pool(t, "counterparty", "transaction_id", pool=30)


def _sampled(spark, sf):
    c = V(spark, sf, "customers_v").select(F.col("customer_id").cast("string"), "is_suspicious")
    return LD.sample_accounts(c.filter("is_suspicious").select("customer_id"),
                              c.filter("not is_suspicious").select("customer_id"), 50, 200)


def q_s07_sample_accounts(spark, sf):
    prep(spark)
    return _sampled(spark, sf)


def q_s08_customer_dimension(spark, sf):
    prep(spark)
    return LD.build_customer_dimension(_sampled(spark, sf)).withColumn(
        "account_open_date", F.col("account_open_date").cast("string"))


def q_s08_customer_dimension_all(spark, sf):
    """Every customer; the query above covers the sampled ids, as its oracle does."""
    prep(spark)
    ids = V(spark, sf, "customers_v").select(F.col("customer_id").cast("string"),
                                             F.col("is_suspicious").cast("int").alias("is_fraud"))
    return LD.build_customer_dimension(ids).withColumn("account_open_date", F.col("account_open_date").cast("string"))


def q_s09_alerts_min(spark, sf):
    prep(spark)
    return LD.build_alerts_min(V(spark, sf, "customers_v"))


def q_s11_export_alert_csv(spark, sf):
    prep(spark)
    path = (f"{checkpoint_dir(spark).rstrip('/')}/exports/{spark.sparkContext.applicationId}/"
            f"{hashlib.md5(sf.encode()).hexdigest()[:12]}/alert_txns")
    t = A.alert_transactions(_alerts(spark, sf), V(spark, sf, "tx_orders"), limit=None)
    t = t.select("alert_id", "transaction_id", "ts_us", "transaction_type", "amount", "currency", "method", "country", "counterparty")
    LD.export_alert_transactions(t, path)
    back = LD.read_alert_transactions(spark, path, t.drop("alert_id").schema)
    return back.groupBy("alert_id").agg(F.count("*").alias("rows"))


def q_s12_table_counts(spark, sf):
    prep(spark)
    tabs = {t: TB.read_table(spark, sf, t) for t in TB.DRIVER_TABLES}
    tabs.update({"tx_orders": V(spark, sf, "tx_orders"), "tx_events": V(spark, sf, "tx_events"),
                 "customers_v": V(spark, sf, "customers_v")})
    return LD.table_counts(tabs)


QUERIES = {
    "s02_load_account_edges": q_s02_load_account_edges,
    "s03_load_paysim": q_s03_load_paysim,
    "s04_load_samld": q_s04_load_samld,
    "s05_load_amlnet": q_s05_load_amlnet,
    "s06_counterparty_pool": q_s06_counterparty_pool,
    "s07_sample_accounts": q_s07_sample_accounts,
    "s08_customer_dimension": q_s08_customer_dimension,
    "s08_customer_dimension_all": q_s08_customer_dimension_all,
    "s09_alerts_min": q_s09_alerts_min,
    "s11_export_alert_csv": q_s11_export_alert_csv,
    "s12_table_counts": q_s12_table_counts,
}

_SAMPLED = """
sm_c AS (SELECT CAST(customer_id AS VARCHAR) AS customer_id, is_suspicious FROM customers_v),
sm_f AS (SELECT customer_id, 1 AS is_fraud FROM sm_c WHERE is_suspicious
         ORDER BY md5(customer_id || '|42'), customer_id LIMIT 50),
sm_l AS (SELECT customer_id, 0 AS is_fraud FROM sm_c WHERE NOT is_suspicious
         ORDER BY md5(customer_id || '|42'), customer_id LIMIT 200),
sampled AS (SELECT * FROM sm_f UNION ALL SELECT * FROM sm_l)"""

ORACLES = {
    "s06_counterparty_pool": with_views(""",
t AS (SELECT transaction_id, counterparty FROM tx_orders WHERE counterparty IS NOT NULL),
f AS (SELECT counterparty, min(transaction_id) AS first FROM t GROUP BY 1),
i AS (SELECT counterparty, row_number() OVER (ORDER BY first, counterparty) - 1 AS idx FROM f)
SELECT t.transaction_id, 'CP' || lpad(CAST(idx % 30 AS VARCHAR), 3, '0') AS counterparty
FROM t JOIN i USING (counterparty)
"""),
    "s07_sample_accounts": with_views("," + _SAMPLED + "\nSELECT customer_id, is_fraud FROM sampled"),
    "s08_customer_dimension": with_views("," + _SAMPLED + f""",
h AS (SELECT *, ('0x' || substr(md5(customer_id || '|cust'), 1, 8))::BIGINT AS h FROM sampled)
SELECT customer_id, CASE WHEN h % 10 < 7 THEN 'individual' ELSE 'business' END AS customer_type,
  CAST(30000 + (h // 10) % 170000 AS DOUBLE) AS annual_income,
  CAST(CAST(DATE '2025-12-31' - CAST(180 + (h // 1000) % 3470 AS INTEGER) AS DATE) AS VARCHAR) AS account_open_date,
  is_fraud = 1 AS is_suspicious,
  CASE WHEN is_fraud = 1 THEN (['structuring', 'rapid_movement', 'layering', 'funnel_account', 'smurfing'])[((h // 100000) % 5) + 1]
       ELSE 'unknown' END AS typology
FROM h
"""),
    "s08_customer_dimension_all": with_views(""",
h AS (SELECT CAST(customer_id AS VARCHAR) AS customer_id, is_suspicious,
        ('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '|cust'), 1, 8))::BIGINT AS h FROM customers_v)
SELECT customer_id, CASE WHEN h % 10 < 7 THEN 'individual' ELSE 'business' END AS customer_type,
  CAST(30000 + (h // 10) % 170000 AS DOUBLE) AS annual_income,
  CAST(CAST(DATE '2025-12-31' - CAST(180 + (h // 1000) % 3470 AS INTEGER) AS DATE) AS VARCHAR) AS account_open_date,
  is_suspicious,
  CASE WHEN is_suspicious THEN (['structuring', 'rapid_movement', 'layering', 'funnel_account', 'smurfing'])[((h // 100000) % 5) + 1]
       ELSE 'unknown' END AS typology
FROM h
"""),
    "s09_alerts_min": with_views("""
SELECT CAST(row_number() OVER (ORDER BY customer_id) - 1 AS BIGINT) AS alert_id, customer_id, typology AS alert_type
FROM customers_v WHERE is_suspicious
"""),
    "s12_table_counts": with_views("\nSELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS rows FROM {t}" for t in
        TB.DRIVER_TABLES + ["tx_orders", "tx_events", "customers_v"]) + ")"),
}


def _listed(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


ORACLES["s02_load_account_edges"] = with_views(f""",
raw AS (
  SELECT CAST(customer_id AS VARCHAR) AS customer_id, counterparty, CAST(amount AS DOUBLE) AS amount,
         floor((ts_us - (SELECT min(ts_us) FROM account_txns)) / {3 * US_DAY}) AS t
  FROM account_txns),
numbered AS (SELECT *, row_number() OVER (ORDER BY customer_id, counterparty, t, amount) - 1 AS i FROM raw),
hashed AS (SELECT *, CAST('0x' || substr(md5(CAST(i AS VARCHAR) || '|amlsim'), 1, 8) AS BIGINT) AS h FROM numbered)
SELECT CAST(i AS VARCHAR) AS transaction_id, customer_id, counterparty, round(amount, 6) AS amount,
  CASE WHEN h % 2 = 0 THEN 'deposit' ELSE 'withdrawal' END AS transaction_type,
  {_listed(LD.AMLSIM_METHODS)}[CAST((h // 2) % {len(LD.AMLSIM_METHODS)} AS INTEGER) + 1] AS method,
  {_listed(LD.AMLSIM_COUNTRIES)}[CAST((h // 8) % {len(LD.AMLSIM_COUNTRIES)} AS INTEGER) + 1] AS country,
  'branch_' || CAST((h // 72) % 19 + 1 AS VARCHAR) AS location,
  epoch_us(TIMESTAMP '2025-01-01' + to_days(CAST(floor(t * 2.5) AS INTEGER))) AS ts_us
FROM hashed
""")

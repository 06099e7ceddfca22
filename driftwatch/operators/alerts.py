"""Alert creation and the investigation queries, set-based over all
alerts at once (one job for the whole alert set, never one query per alert).

Filters are ``Column`` predicates on the transaction scan, so Catalyst pushes
them into Parquet; alerts join transactions on ``customer_id``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions import dims
from driftwatch.functions.ids import consecutive_index, md5_int

K = "customer_id"
ANALYSTS = [f"analyst_{i:02d}" for i in range(1, 13)]


def usd_amount(amount="amount", rate="usd_rate") -> F.Column:
    """Amount × coalesce(usd_rate, 1)."""
    return F.col(amount) * F.coalesce(F.col(rate), F.lit(1.0))


def create_alerts(customers: DataFrame, txns: DataFrame, gray_share: float = dims.GRAY_ALERT_SHARE) -> DataFrame:
    """One alert per suspicious customer with rows, plus a hash-chosen
    ``gray_share`` of the gray-area customers (typology from their profile,
    default structuring).  Severity and analyst are hash choices in place of
    random draws.  alert_id is consecutive: suspicious first, then gray, each
    by customer id."""
    h = md5_int(K)
    prof = F.create_map(*[x for k, v in dims.GRAY_PROFILE_TO_TYPOLOGY.items() for x in (F.lit(k), F.lit(v))])
    c = customers.select(K, "is_suspicious", "is_gray_area", "gray_profile", "typology")
    gray_pick = F.col("is_gray_area") & ~F.col("is_suspicious") & ((md5_int(F.concat(F.col(K).cast("string"), F.lit("|gray"))) % 1000) < int(gray_share * 1000))
    c = c.filter(F.col("is_suspicious") | gray_pick).select(
        K,
        F.when(F.col("is_suspicious"), 0).otherwise(1).alias("_grp"),
        F.when(F.col("is_suspicious"), F.coalesce("typology", F.lit("structuring")))
        .otherwise(F.coalesce(F.try_element_at(prof, F.col("gray_profile")), F.lit("structuring"))).alias("alert_type"),
        F.when(F.col("is_suspicious"), F.when(h % 10 < 8, "high").otherwise("medium"))
        .otherwise(F.when(h % 10 < 2, "high").when(h % 10 < 7, "medium").otherwise("low")).alias("severity"),
        F.element_at(F.array(*[F.lit(a) for a in ANALYSTS]), (h % len(ANALYSTS) + 1).cast("int")).alias("assigned_analyst"),
    )
    agg = txns.groupBy(K).agg(F.max("ts_us").alias("_last_us"), F.sum("amount").alias("_tot"),
                              F.count("*").alias("num_transactions"), F.avg("amount").alias("_avg"))
    a = c.join(agg, K)  # customers without rows get no alert
    a = consecutive_index(a, ["_grp", K], "alert_id")
    return a.select(
        "alert_id", K,
        F.timestamp_micros("_last_us").alias("alert_date"),
        F.col("_last_us").alias("alert_date_us"),
        "alert_type", "severity",
        F.round("_tot", 2).alias("total_amount"),
        F.col("num_transactions").cast("long"),
        F.round("_avg", 2).alias("avg_transaction_amount"),
        F.lit("open").alias("status"), "assigned_analyst",
        F.lit(False).alias("sar_filed"),
    )


def alert_transactions(alerts: DataFrame, txns: DataFrame, country=None, method=None, txn_type=None,
                       min_amount=None, max_amount=None, limit: int | None = 500,
                       case_insensitive: bool = False, start_date=None, end_date=None,
                       counterparty=None) -> DataFrame:
    """Each alert's transactions with optional predicates, newest
    first, at most ``limit`` per alert (a per-group top-k; Spark plans a
    partial group limit before the shuffle); ``None`` gives every row, unranked,
    as an export needs.  A03 mode compares text
    case-insensitively, ignores falsy bounds and adds a date range and a
    counterparty substring."""
    t = txns
    def eq(col, v):
        if case_insensitive:
            return F.lower(F.col(col)) == F.lower(F.lit(v))
        return F.col(col) == F.lit(v)
    if country:
        t = t.filter(eq("country", country))
    if method:
        t = t.filter(eq("method", method))
    if txn_type:
        t = t.filter(eq("transaction_type", txn_type))
    if (min_amount if case_insensitive else min_amount is not None):
        t = t.filter(F.col("amount") >= F.lit(float(min_amount)))
    if (max_amount if case_insensitive else max_amount is not None):
        t = t.filter(F.col("amount") <= F.lit(float(max_amount)))
    if start_date:
        t = t.filter(F.col("transaction_date") >= F.lit(start_date).cast("timestamp"))
    if end_date:
        t = t.filter(F.col("transaction_date") <= F.lit(end_date).cast("timestamp"))
    if counterparty:
        t = t.filter(F.lower(F.col("counterparty")).contains(str(counterparty).lower()))
    j = alerts.select("alert_id", K).join(t, K)
    w = Window.partitionBy("alert_id").orderBy(F.col("ts_us").desc(), F.col("transaction_id").desc())
    if limit is None:
        return j.withColumn("rank", F.lit(None).cast("int"))
    return (j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .withColumn("usd_amount", F.round(usd_amount(), 2)))


def transaction_by_id(alerts: DataFrame, txns: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(alert_id, transaction_id)`` resolved within each alert's
    customer only, with the USD value."""
    a = alerts.select("alert_id", K).join(wanted, "alert_id")
    return a.join(txns, [K, "transaction_id"]).withColumn("usd_equivalent", F.round(usd_amount(), 2))


def counterparty_profile(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    """Per alert and counterparty: rows, USD total, rows by type."""
    j = alerts.select("alert_id", K).join(txns.filter(F.col("counterparty").isNotNull()), K)
    return j.groupBy("alert_id", "counterparty").agg(
        F.count("*").alias("txn_count"),
        F.sum(usd_amount()).alias("usd_total"),
        F.count(F.when(F.col("transaction_type") == "deposit", 1)).alias("deposits"),
        F.count(F.when(F.col("transaction_type") == "withdrawal", 1)).alias("withdrawals"),
    )


def timeline_slice(alerts: DataFrame, txns: DataFrame, start_us: int | None = None,
                   end_us: int | None = None) -> DataFrame:
    """Per alert, rows in [start, end]: count, USD total, first and last time."""
    t = txns
    if start_us is not None:
        t = t.filter(F.col("ts_us") >= start_us)
    if end_us is not None:
        t = t.filter(F.col("ts_us") <= end_us)
    j = alerts.select("alert_id", K).join(t, K)
    return j.groupBy("alert_id").agg(F.count("*").alias("txn_count"), F.sum(usd_amount()).alias("usd_total"),
                                     F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def transaction_summary(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    """Counts, USD totals by type, net flow, date range per alert."""
    j = alerts.select("alert_id", K).join(txns, K)
    u = usd_amount()
    dep = F.col("transaction_type") == "deposit"
    wd = F.col("transaction_type") == "withdrawal"
    s = j.groupBy("alert_id").agg(
        F.count("*").alias("total_transactions"),
        F.count(F.when(dep, 1)).alias("num_deposits"),
        F.count(F.when(wd, 1)).alias("num_withdrawals"),
        F.sum(F.when(dep, u).otherwise(0.0)).alias("deposits_usd"),
        F.sum(F.when(wd, u).otherwise(0.0)).alias("withdrawals_usd"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    )
    return s.withColumn("net_flow_usd", F.col("deposits_usd") - F.col("withdrawals_usd")) \
        .withColumn("first_date", F.timestamp_micros("first_us").cast("date")) \
        .withColumn("last_date", F.timestamp_micros("last_us").cast("date"))


def breakdown(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    """Per alert, rows and USD by country, by method, by month, and
    rows by currency, as one GROUPING SETS aggregate."""
    j = (alerts.select("alert_id", K).join(txns, K)
         .withColumn("month", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM"))
         .withColumn("usd", usd_amount()))
    sets = [["alert_id", c] for c in ("country", "method", "month", "currency")]
    g = j.groupingSets(sets, "alert_id", "country", "method", "month", "currency").agg(
        F.count("*").alias("txn_count"), F.sum("usd").alias("usd_total"),
        F.grouping("country").alias("_gc"), F.grouping("method").alias("_gm"), F.grouping("month").alias("_gt"))
    dim = (F.when(F.col("_gc") == 0, "country").when(F.col("_gm") == 0, "method")
           .when(F.col("_gt") == 0, "month").otherwise("currency"))
    return g.select("alert_id", dim.alias("dimension"),
                    F.coalesce("country", "method", "month", "currency").alias("value"),
                    "txn_count", "usd_total")


def prior_alerts(alerts: DataFrame) -> DataFrame:
    """For each alert, the other alerts of the same customer, newest first."""
    a = alerts.select("alert_id", K)
    b = alerts.select(F.col("alert_id").alias("prior_alert_id"), K, "alert_type", "severity",
                      "total_amount", "alert_date_us")
    j = a.join(b, K).filter(F.col("alert_id") != F.col("prior_alert_id"))
    w = Window.partitionBy("alert_id").orderBy(F.col("alert_date_us").desc(), F.col("prior_alert_id").desc())
    return j.withColumn("position", F.row_number().over(w))


def alert_record(alerts: DataFrame, customers: DataFrame, txns: DataFrame) -> DataFrame:
    """A10: alert ⋈ customer plus the customer's number of transactions."""
    n = txns.groupBy(K).agg(F.count("*").alias("customer_num_transactions"))
    return alerts.join(customers, K).join(n, K, "left").fillna({"customer_num_transactions": 0})


def alert_list(alerts: DataFrame, customers: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Alerts with customer name and (when given) the model score."""
    a = alerts.join(customers.select(K, "name"), K, "left")
    if scores is not None:
        a = a.join(scores.select(K, "risk_score").dropDuplicates([K]), K, "left")
    return a


def behavioural_record(features: DataFrame, bsi: DataFrame, monitor: DataFrame) -> DataFrame:
    """Features ⟕ bsi ⟕ monitoring, the last two nested as structs."""
    b = bsi.select(K, F.struct(*[c for c in bsi.columns if c != K]).alias("bsi"))
    m = monitor.select(K, F.struct(*[c for c in monitor.columns if c != K]).alias("monitoring"))
    return features.join(b, K, "left").join(m, K, "left")


def transaction_lines(alerts: DataFrame, txns: DataFrame, limit: int = 100) -> DataFrame:
    """One text line per transaction (USD hint for non-USD, counterparty,
    country tag unless USA, crypto asset), the newest ``limit`` per alert,
    plus the count of lines not shown."""
    j = alerts.select("alert_id", K).join(txns, K)
    usd = usd_amount()
    amt = F.when(F.coalesce(F.col("currency"), F.lit("USD")) != "USD",
                 F.format_string("%s %s (≈$%s USD)", F.format_number("amount", 8), F.col("currency"),
                                 F.format_number(usd, 2))) \
        .otherwise(F.concat(F.lit("$"), F.format_number("amount", 2)))
    ttype = F.initcap("transaction_type")
    line = F.concat(
        F.lit("- "), F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd"), F.lit("  "),
        F.rpad(ttype, 12, " "), F.lit(" "), F.rpad(amt, 35, " "), F.lit(" via "), F.col("method"),
        F.when(F.col("counterparty").isNotNull() & ~F.col("counterparty").isin("", "None", "nan"),
               F.concat(F.lit(" | "), F.col("counterparty"))).otherwise(F.lit("")),
        F.when(F.col("country").isNotNull() & (F.col("country") != "") & (F.col("country") != "USA"),
               F.concat(F.lit(" ["), F.col("country"), F.lit("]"))).otherwise(F.lit("")),
        F.when(F.col("crypto_asset").isNotNull() & ~F.col("crypto_asset").isin("", "None", "nan"),
               F.concat(F.lit(" ("), F.col("crypto_asset"), F.lit(")"))).otherwise(F.lit("")),
    )
    w = Window.partitionBy("alert_id").orderBy(F.col("ts_us").desc(), F.col("transaction_id").desc())
    total = j.groupBy("alert_id").agg(F.count("*").alias("_n"))
    shown = j.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
    return (shown.select("alert_id", "position", line.alias("line")).join(total, "alert_id")
            .withColumn("more_not_shown", F.greatest(F.col("_n") - limit, F.lit(0))).drop("_n"))


def case_header(alerts: DataFrame, customers: DataFrame, txns: DataFrame) -> DataFrame:
    """One struct of header facts per alert: alert, customer profile,
    transaction summary (A07), breakdown (A08, as arrays), prior alerts (A09)."""
    s = transaction_summary(alerts, txns)
    bd = breakdown(alerts, txns).groupBy("alert_id").agg(
        F.sort_array(F.collect_list(F.struct("dimension", "value", "txn_count", "usd_total"))).alias("breakdown"))
    pr = prior_alerts(alerts).groupBy("alert_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "prior_alert_id", "alert_type", "severity",
                                             "total_amount"))).alias("prior_alerts"))
    c = customers.select(K, "name", "customer_type", "annual_income", "account_open_date")
    return (alerts.join(c, K, "left").join(s, "alert_id", "left").join(bd, "alert_id", "left")
            .join(pr, "alert_id", "left")
            .withColumn("prior_alert_count", F.coalesce(F.size("prior_alerts"), F.lit(0)))
            .withColumn("prior_alerts", F.coalesce("prior_alerts", F.array())))

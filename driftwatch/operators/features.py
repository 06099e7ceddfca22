"""Classifier features per customer.

F01–F03 are one grouped aggregate over the transactions (conditional counts
and sums; partial aggregation makes a hot customer cost one partial row per
map task); distinct values are counted apart from it, and F02 needs one row per customer and day.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions import dims
from driftwatch.functions.exprs import US_PER_DAY, lookup
from driftwatch.operators.sequence import short_gaps

K = "customer_id"

TRADITIONAL_COLS = [
    "customer_type_business", "annual_income", "account_age_days", "total_transactions",
    "total_volume", "avg_transaction_amount", "max_transaction_amount", "std_transaction_amount",
    "transaction_date_range_days", "num_deposits", "num_withdrawals", "deposit_withdrawal_ratio",
    "total_deposits", "total_withdrawals", "num_cash_txns", "num_wire_txns", "pct_cash", "pct_wire",
    "total_cash_amount", "num_intl_txns", "num_high_risk_country_txns", "pct_intl",
    "total_intl_amount", "num_just_under_10k", "pct_just_under_10k", "num_rapid_sequence_txns",
    "avg_days_between_txns", "volume_to_income_ratio", "usd_volume", "log_usd_volume",
    "avg_ppp_asymmetry", "num_unique_counterparties", "num_unique_locations", "num_crypto_txns",
    "total_crypto_volume", "log_crypto_volume", "num_currencies_used",
    "crypto_volume_to_income_ratio",
]


def not_usa(c="country") -> F.Column:
    """pandas ``country != 'USA'`` is true for null too."""
    return ~F.col(c).eqNullSafe(F.lit("USA"))


def _ppl(country) -> F.Column:
    return lookup(dims.COUNTRY_PPL, country, dims.DEFAULT_PPL)


def rapid_sequence(txns: DataFrame) -> DataFrame:
    """gaps under 2 days, and whole days of the mean gap."""
    g = short_gaps(txns.select(K, "ts_us"), K, 2 * US_PER_DAY, out="num_rapid_sequence_txns")
    return g.select(
        K, F.col("num_rapid_sequence_txns").cast("long"),
        F.when(F.col("_n") >= 2, F.floor((F.col("_mx") - F.col("_mn")) / ((F.col("_n") - 1) * F.lit(US_PER_DAY))))
        .otherwise(F.lit(0)).cast("long").alias("avg_days_between_txns"))


def distinct_values(txns: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per customer: the number of different values of each column, as its name in ``columns``.

    Each row gives its values as (customer, column, value), which are dealt and made one by all three. Beside other
    aggregates Spark would carry the state of all of them through that exchange, once more for each column."""
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)])
    each = txns.select(K, F.inline(values)).filter(F.col("v").isNotNull()).distinct()
    return each.groupBy(K).agg(*[F.count(F.when(F.col("i") == i, 1)).alias(name) for i, name in enumerate(columns.values())])


def traditional_features(customers: DataFrame, txns: DataFrame,
                         reference_date: str = dims.ACCOUNT_AGE_REFERENCE) -> DataFrame:
    """F01 (+F02, F03): 38 columns per customer with rows, then label columns."""
    t = txns  # the aggregates meet the customers below
    amt = F.col("amount")
    dep = F.col("transaction_type") == "deposit"
    wd = F.col("transaction_type") == "withdrawal"
    cash = F.col("method") == "cash"
    wire = F.col("method") == "wire"
    intl = not_usa()
    hr = F.col("country").isin(*dims.HIGH_RISK_COUNTRIES)
    band = (amt >= dims.STRUCTURING_LO) & (amt < dims.STRUCTURING_HI)
    crypto = F.col("method") == "crypto_exchange"
    cust_ppl = 1.0  # customers carry no country: USA
    cp_ppl = _ppl(F.col("country"))
    asym = F.when(intl & wire, F.when(dep, F.log(F.lit(cust_ppl) / cp_ppl)).otherwise(F.log(cp_ppl / F.lit(cust_ppl))))
    usd = amt * F.coalesce(F.col("usd_rate"), F.lit(1.0))

    a = t.groupBy(K).agg(
        F.count("*").alias("total_transactions"),
        F.sum(amt).alias("total_volume"),
        F.avg(amt).alias("avg_transaction_amount"),
        F.max(amt).alias("max_transaction_amount"),
        F.stddev_samp(amt).alias("_std"),
        F.min("ts_us").alias("_mn"), F.max("ts_us").alias("_mx"),
        F.count(F.when(dep, 1)).alias("num_deposits"),
        F.count(F.when(wd, 1)).alias("num_withdrawals"),
        F.sum(F.when(dep, amt).otherwise(0.0)).alias("total_deposits"),
        F.sum(F.when(wd, amt).otherwise(0.0)).alias("total_withdrawals"),
        F.count(F.when(cash, 1)).alias("num_cash_txns"),
        F.count(F.when(wire, 1)).alias("num_wire_txns"),
        F.sum(F.when(cash, amt).otherwise(0.0)).alias("total_cash_amount"),
        F.count(F.when(intl, 1)).alias("num_intl_txns"),
        F.count(F.when(hr, 1)).alias("num_high_risk_country_txns"),
        F.sum(F.when(intl, amt).otherwise(0.0)).alias("total_intl_amount"),
        F.count(F.when(band, 1)).alias("num_just_under_10k"),
        F.sum(usd).alias("usd_volume"),
        F.avg(asym).alias("_ppp"),
        F.count(F.when(crypto, 1)).alias("num_crypto_txns"),
        F.sum(F.when(crypto, amt).otherwise(0.0)).alias("total_crypto_volume"),
    )
    different = {"counterparty": "num_unique_counterparties", "location": "num_unique_locations", "currency": "num_currencies_used"}
    c = customers.select(K, "customer_type", "annual_income", "account_open_date",
                         "is_suspicious", "typology")
    j = (a.join(c, K).join(rapid_sequence(t), K).join(distinct_values(t, different), K, "left")
         .fillna(0, list(different.values())))  # a customer without any value has no row there
    n = F.col("total_transactions")
    inc1 = F.col("annual_income") + 1
    return j.select(
        K,
        F.when(F.col("customer_type") == "business", 1).otherwise(0).alias("customer_type_business"),
        F.col("annual_income"),
        F.datediff(F.lit(reference_date).cast("date"), F.col("account_open_date")).cast("long").alias("account_age_days"),
        n.cast("long").alias("total_transactions"),
        "total_volume", "avg_transaction_amount", "max_transaction_amount",
        F.when(n > 1, F.col("_std")).otherwise(F.lit(0.0)).alias("std_transaction_amount"),
        F.greatest(F.floor((F.col("_mx") - F.col("_mn")) / F.lit(US_PER_DAY)), F.lit(1)).cast("long").alias("transaction_date_range_days"),
        F.col("num_deposits").cast("long"), F.col("num_withdrawals").cast("long"),
        (F.col("num_deposits") / (F.col("num_withdrawals") + 1)).alias("deposit_withdrawal_ratio"),
        "total_deposits", "total_withdrawals",
        F.col("num_cash_txns").cast("long"), F.col("num_wire_txns").cast("long"),
        (F.col("num_cash_txns") / n).alias("pct_cash"), (F.col("num_wire_txns") / n).alias("pct_wire"),
        "total_cash_amount",
        F.col("num_intl_txns").cast("long"), F.col("num_high_risk_country_txns").cast("long"),
        (F.col("num_intl_txns") / n).alias("pct_intl"), "total_intl_amount",
        F.col("num_just_under_10k").cast("long"), (F.col("num_just_under_10k") / n).alias("pct_just_under_10k"),
        "num_rapid_sequence_txns", "avg_days_between_txns",
        (F.col("usd_volume") / inc1).alias("volume_to_income_ratio"),
        "usd_volume", F.log1p("usd_volume").alias("log_usd_volume"),
        F.coalesce(F.round(F.col("_ppp") * 10000) / 10000, F.lit(0.0)).alias("avg_ppp_asymmetry"),
        F.col("num_unique_counterparties").cast("long"), F.col("num_unique_locations").cast("long"),
        F.col("num_crypto_txns").cast("long"), "total_crypto_volume",
        F.when(F.col("num_crypto_txns") > 0, F.log1p("total_crypto_volume")).otherwise(F.lit(0.0)).alias("log_crypto_volume"),
        F.col("num_currencies_used").cast("long"),
        F.when(F.col("num_crypto_txns") > 0, F.col("total_crypto_volume") / inc1).otherwise(F.lit(0.0)).alias("crypto_volume_to_income_ratio"),
        F.col("is_suspicious").cast("int").alias("is_suspicious"),
        F.when(F.col("is_suspicious"), F.col("typology")).otherwise(F.lit("normal")).alias("typology"),
    )


BSI_MERGE_COLS = ["bsi_score", "entropy_stability", "temporal_stability",
                  "counterparty_stability", "amount_stability", "network_stability"]


def merge_features(traditional: DataFrame, behavioural: DataFrame, graph: DataFrame,
                   bsi: DataFrame) -> DataFrame:
    """left joins on customer_id, then null -> 0 (numbers) / false."""
    b = bsi.select(K, *[c for c in BSI_MERGE_COLS if c in bsi.columns])
    m = traditional.join(behavioural, K, "left").join(graph, K, "left").join(b, K, "left")
    fills = {}
    for f in m.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            fills[f.name] = 0
    m = m.fillna(fills)
    bools = [f.name for f in m.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return m.fillna({c: False for c in bools}) if bools else m


def sanitize(df: DataFrame, exclude=(K, "typology")) -> DataFrame:
    """±inf -> null, clip to ±1e12, null -> 0, booleans -> 0/1."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in exclude:
            cols.append(c)
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.coalesce(c.cast("int"), F.lit(0)).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            finite = F.when(F.isnan(c) | (F.abs(c) == F.lit(math.inf)), F.lit(None)).otherwise(c)
            cols.append(F.coalesce(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), finite)), F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            cols.append(F.coalesce(c, F.lit(0)).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def stratified_split(df: DataFrame, label: str = "is_suspicious", test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """deterministic split; of each class's n rows the floor(``test_share`` * n) with the smallest
    (md5 of (id, seed), id) are the test part.

    The last test row of a class is found without ranking the class: a histogram over the
    first 20 bits of the hash names the bin it lies in, and only that bin's rows (a
    millionth) are ranked. One row per class, the bin and that row, goes back to all rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(K).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    d = df.withColumn("_h", h).withColumn("_bin", F.shiftright("_h", 40))
    whole = Window.partitionBy(label)
    bins = d.groupBy(label, "_bin").agg(F.count("*").alias("_c"))
    bins = bins.select(label, "_bin", "_c", F.sum("_c").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
                       F.floor(F.lit(test_share) * F.sum("_c").over(whole)).alias("_k"))
    cut = bins.groupBy(label).agg(F.min(F.when(F.col("_cum") > F.col("_k"), F.struct("_bin", (F.col("_k") - F.col("_cum") + F.col("_c")).alias("r")))).alias("_at"))
    cut = cut.select(F.col(label).alias("_class"), F.col("_at._bin").alias("_b"), F.col("_at.r").alias("_r"))
    same = lambda: F.col(label).eqNullSafe(F.col("_class"))
    edge = d.join(F.broadcast(cut), same()).filter(F.col("_bin") == F.col("_b"))  # one row per class is broadcast
    edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy("_class").orderBy("_h", K)))
    last = edge.filter(F.col("_rank") == F.col("_r")).select(F.col("_class").alias("_of"), F.struct("_h", K).alias("_last"))
    cut = cut.join(last, F.col("_class").eqNullSafe(F.col("_of")), "left").drop("_of")
    # without a bin beyond the test part the class is all test
    test = F.col("_b").isNull() | (F.col("_bin") < F.col("_b")) | F.coalesce((F.col("_bin") == F.col("_b")) & (F.struct("_h", K) <= F.col("_last")), F.lit(False))
    return d.join(F.broadcast(cut), same()).withColumn("is_test", test).select(*df.columns, "is_test")

"""Loaders for external account datasets, sampling,
customer dimension, minimal alerts, per-alert export and table counts.

The reference draws random types, methods and countries for some external
sets; here every such choice is a hash pick on the row key
(``conv(substr(md5(key), 1, 8), 16, 10) % n``), so loads are reproducible and
identical in DuckDB.  Row ids are consecutive in a stated order
(``functions.ids``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions import dims
from driftwatch.functions.ids import consecutive_index, md5_int

BASE_DATE = "2025-01-01"
US_DAY = 86_400_000_000

# FIXED VALUES: external-format maps (reference order)
PAYSIM_TYPE_MAP = {"CASH_IN": ("deposit", "cash"), "CASH_OUT": ("withdrawal", "cash"),
                   "DEBIT": ("withdrawal", "ach"), "PAYMENT": ("withdrawal", "ach"),
                   "TRANSFER": ("withdrawal", "wire")}
SAMLD_COLUMN_ALIASES = {"From_ID": "From_ID", "from_id": "From_ID", "SOURCE": "From_ID",
                        "To_ID": "To_ID", "to_id": "To_ID", "TARGET": "To_ID",
                        "Amount_Sent": "Amount_Sent", "amount": "Amount_Sent",
                        "Timestamp": "Timestamp", "time": "Timestamp",
                        "Is_Laundering": "Is_Laundering", "label": "Is_Laundering",
                        "Payment_Format": "Payment_Format", "Sending_Currency": "Sending_Currency"}
SAMLD_FORMAT_METHOD = {"Wire": "wire", "ACH": "ach", "Cheque": "check", "Cash": "cash",
                       "Credit": "ach", "Bitcoin": "wire"}
SAMLD_CURRENCY_COUNTRY = {"US Dollar": "USA", "Euro": "Germany", "British Pound": "UK",
                          "Chinese Yuan": "China", "UAE Dirham": "UAE", "Swiss Franc": "Switzerland",
                          "Mexican Peso": "Mexico", "Brazilian Real": "Brazil"}
AMLNET_TYPE_MAP = {"TRANSFER": ("withdrawal", "wire"), "OSKO": ("withdrawal", "wire"),
                   "NPP": ("withdrawal", "wire"), "BPAY": ("withdrawal", "ach"),
                   "EFTPOS": ("withdrawal", "cash"), "DEBIT": ("withdrawal", "ach"),
                   "CASH_OUT": ("withdrawal", "cash"), "PAYMENT": ("withdrawal", "ach")}
AMLNET_CATEGORY_COUNTRY = {"Shell Company": "Cayman Islands", "Cryptocurrency": "UAE",
                           "Property Investment": "Australia", "Other": "Australia"}
AMLSIM_METHODS = ["wire", "ach", "check", "cash"]
AMLSIM_COUNTRIES = ["USA", "USA", "USA", "USA", "UK", "China", "UAE", "Panama", "Cayman Islands"]
EXTERNAL_FRAUD_TYPOLOGIES = ["structuring", "rapid_movement", "layering", "funnel_account", "smurfing"]


def _map(d: dict, key: F.Column, idx: int | None = None, default=None) -> F.Column:
    vals = {k: (v[idx] if idx is not None else v) for k, v in d.items()}
    m = F.create_map(*[x for k, v in vals.items() for x in (F.lit(k), F.lit(v))])
    out = F.try_element_at(m, key)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def _pick(options: list, h: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (h % len(options) + 1).cast("int"))


def _canonical(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_us", F.unix_micros(F.col("transaction_date").cast("timestamp")))


# ------------------------------------------------------------------ S02
def load_account_edges(nodes: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S02 (AMLSim): ``nodes(nodeid, isFraud)``, ``raw(sourceNodeId,
    targetNodeId, value, time)`` → (transactions, fraud ids).  time step t →
    2025-01-01 + int(t·2.5) days; type / method / country / branch by hash."""
    t = raw.select(F.col("sourceNodeId").cast("string").alias("customer_id"),
                   F.col("targetNodeId").cast("string").alias("counterparty"),
                   F.col("value").cast("double").alias("amount"), F.col("time").cast("double").alias("_t"))
    t = consecutive_index(t, ["customer_id", "counterparty", "_t", "amount"], "transaction_id")
    h = md5_int(F.concat_ws("|", F.col("transaction_id").cast("string"), F.lit("amlsim")))
    out = t.select(
        F.col("transaction_id").cast("string"), "customer_id", "counterparty", "amount",
        F.date_add(F.lit(BASE_DATE).cast("date"), F.floor(F.col("_t") * 2.5).cast("int")).cast("timestamp").alias("transaction_date"),
        F.when(h % 2 == 0, "deposit").otherwise("withdrawal").alias("transaction_type"),
        _pick(AMLSIM_METHODS, F.floor(h / 2)).alias("method"),
        _pick(AMLSIM_COUNTRIES, F.floor(h / 8)).alias("country"),
        F.concat(F.lit("branch_"), (F.floor(h / 72) % 19 + 1).cast("string")).alias("location"))
    fraud = nodes.filter(F.col("isFraud") == 1).select(F.col("nodeid").cast("string").alias("customer_id"))
    return _canonical(out), fraud


# ------------------------------------------------------------------ S03
def load_paysim(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S03 (PaySim): type → (transaction_type, method) with default
    (withdrawal, ach); date = base + int(step/24) days; fraud = accounts with
    any fraud row."""
    t = consecutive_index(raw, ["step", "nameOrig", "nameDest", "amount"], "_i")
    h = md5_int(F.concat_ws("|", F.col("_i").cast("string"), F.lit("paysim")))
    out = t.select(
        F.col("_i").cast("string").alias("transaction_id"),
        F.col("nameOrig").cast("string").alias("customer_id"),
        F.col("nameDest").cast("string").alias("counterparty"),
        F.col("amount").cast("double").alias("amount"),
        F.date_add(F.lit(BASE_DATE).cast("date"), F.floor(F.col("step") / 24).cast("int")).cast("timestamp").alias("transaction_date"),
        _map(PAYSIM_TYPE_MAP, F.col("type"), 0, "withdrawal").alias("transaction_type"),
        _map(PAYSIM_TYPE_MAP, F.col("type"), 1, "ach").alias("method"),
        F.when(h % 100 < 60, "USA").otherwise(_pick(["USA", "UK", "China", "Mexico", "Panama", "UAE"], F.floor(h / 100)))
        .alias("country"),
        F.concat(F.lit("branch_"), (F.floor(h / 10000) % 29 + 1).cast("string")).alias("location"))
    fraud = raw.filter(F.col("isFraud") == 1).select(F.col("nameOrig").cast("string").alias("customer_id")).distinct()
    return _canonical(out), fraud


# ------------------------------------------------------------------ S04
def load_samld(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S04 (SAML-D): trimmed and aliased columns, format → method, currency →
    country, timestamp text → else epoch-step days → else row index days,
    amount coerced (bad → 0)."""
    r = raw.toDF(*[c.strip() for c in raw.columns])
    r = r.withColumnsRenamed({k: v for k, v in SAMLD_COLUMN_ALIASES.items() if k in r.columns and k != v})
    r = consecutive_index(r, [F.col("From_ID").cast("string"), F.col("To_ID").cast("string"),
                              F.col("Timestamp").cast("string")], "_i")
    ts_txt = F.col("Timestamp").cast("string")
    ts = F.coalesce(F.try_to_timestamp(ts_txt),
                    F.date_add(F.lit(BASE_DATE).cast("date"), F.floor(ts_txt.try_cast("double")).cast("int")).cast("timestamp"),
                    F.date_add(F.lit(BASE_DATE).cast("date"), F.col("_i").cast("int")).cast("timestamp"))
    h = md5_int(F.concat_ws("|", F.col("_i").cast("string"), F.lit("samld")))
    fmt = F.col("Payment_Format").cast("string") if "Payment_Format" in r.columns else F.lit(None).cast("string")
    cur = F.col("Sending_Currency").cast("string") if "Sending_Currency" in r.columns else F.lit("US Dollar")
    out = r.select(
        F.col("_i").cast("string").alias("transaction_id"),
        F.col("From_ID").cast("string").alias("customer_id"), F.col("To_ID").cast("string").alias("counterparty"),
        F.coalesce(F.col("Amount_Sent").cast("string").try_cast("double"), F.lit(0.0)).alias("amount"),
        ts.alias("transaction_date"),
        F.when(h % 10 < 6, "withdrawal").otherwise("deposit").alias("transaction_type"),
        _map(SAMLD_FORMAT_METHOD, fmt, None, "wire").alias("method"),
        _map(SAMLD_CURRENCY_COUNTRY, cur, None, "USA").alias("country"),
        F.concat(F.lit("branch_"), (F.floor(h / 10) % 29 + 1).cast("string")).alias("location"))
    fraud = r.filter(F.col("Is_Laundering") == 1).select(F.col("From_ID").cast("string").alias("customer_id")).distinct()
    return _canonical(out), fraud


# ------------------------------------------------------------------ S05 / S06
def remap_counterparty_pool(df: DataFrame, col: str = "counterparty", order_col: str = "transaction_id",
                            pool: int = 300, prefix: str = "CP") -> DataFrame:
    """The i-th distinct value (first-seen order) → ``CP{i % pool:03d}``;
    distinct values are numbered with the distributed consecutive index."""
    first = df.groupBy(col).agg(F.min(order_col).alias("_first"))
    idx = consecutive_index(first, ["_first", col], "_i")
    m = idx.select(col, F.concat(F.lit(prefix), F.lpad((F.col("_i") % pool).cast("string"), 3, "0")).alias("_cp"))
    return df.join(m, col, "left").withColumn(col, F.col("_cp")).drop("_cp")


def load_amlnet(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S05 (AMLNet): destinations pooled (S06), date from month/day/hour with
    invalid → base date, type map, category → country (default Australia),
    location ``AU_`` + the first capital-letter run of the id; typology per
    account = first laundering typology.  Returns (txns, fraud ids, typologies)."""
    r = consecutive_index(raw, ["step", "nameOrig", "nameDest", "amount"], "_i")
    r = r.withColumn("transaction_id", F.col("_i").cast("string"))
    r = remap_counterparty_pool(r.withColumnRenamed("nameDest", "counterparty"), "counterparty", "_i")
    txt = F.format_string("2025-%s-%s %s:00:00", F.lpad(F.col("month").cast("string"), 2, "0"),
                          F.lpad(F.col("day_of_month").cast("string"), 2, "0"), F.lpad(F.col("hour").cast("string"), 2, "0"))
    ts = F.coalesce(F.try_to_timestamp(txt, F.lit("yyyy-MM-dd HH:mm:ss")), F.lit(BASE_DATE).cast("timestamp"))
    letters = F.regexp_extract(F.col("nameOrig").cast("string"), "([A-Z]+)", 1)
    out = r.select(
        "transaction_id", F.col("nameOrig").cast("string").alias("customer_id"), "counterparty",
        F.col("amount").cast("double"), ts.alias("transaction_date"),
        _map(AMLNET_TYPE_MAP, F.col("type"), 0, "withdrawal").alias("transaction_type"),
        _map(AMLNET_TYPE_MAP, F.col("type"), 1, "ach").alias("method"),
        _map(AMLNET_CATEGORY_COUNTRY, F.col("category"), None, "Australia").alias("country"),
        F.concat(F.lit("AU_"), F.when(letters != "", letters).otherwise(F.lit("C"))).alias("location"),
        F.col("isMoneyLaundering").alias("is_money_laundering"), "laundering_typology", "fraud_probability", "_i")
    fraud = raw.filter(F.col("isMoneyLaundering") == 1).select(F.col("nameOrig").cast("string").alias("customer_id")).distinct()
    typ = (out.filter(F.col("is_money_laundering") == 1).groupBy("customer_id")
           .agg(F.min_by("laundering_typology", "_i").alias("typology")))
    return _canonical(out.drop("_i")), fraud, typ


# ------------------------------------------------------------------ S07–S09
def sample_accounts(fraud: DataFrame, legit: DataFrame, max_fraud: int, max_legit: int, seed: int = 42) -> DataFrame:
    """Up to ``max_fraud`` / ``max_legit`` ids per class, chosen by
    md5(id, seed) order (a sampling operator: the limits are its purpose;
    each is a bounded top-k)."""
    key = lambda: F.md5(F.concat_ws("|", F.col("customer_id"), F.lit(str(seed))))
    f = fraud.distinct().orderBy(key(), "customer_id").limit(max_fraud).withColumn("is_fraud", F.lit(1))
    lg = legit.distinct().join(fraud, "customer_id", "left_anti").orderBy(key(), "customer_id").limit(max_legit) \
        .withColumn("is_fraud", F.lit(0))
    return f.unionByName(lg)


def keep_sampled(txns: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows of the sampled accounts only (semi join)."""
    return txns.join(sampled.select("customer_id"), "customer_id", "left_semi")


def build_customer_dimension(ids: DataFrame) -> DataFrame:
    """Customer columns for external ids, from hashes of the id only
    (label-independent on purpose, unlike the reference whose income and age
    depend on the label)."""
    h = md5_int(F.concat_ws("|", F.col("customer_id"), F.lit("cust")))
    return ids.select(
        "customer_id",
        F.when(h % 10 < 7, "individual").otherwise("business").alias("customer_type"),
        (F.lit(30000.0) + (F.floor(h / 10) % 170000)).cast("double").alias("annual_income"),
        F.date_sub(F.lit(dims.ACCOUNT_AGE_REFERENCE).cast("date"), (180 + F.floor(h / 1000) % 3470).cast("int")).alias("account_open_date"),
        F.col("is_fraud").cast("boolean").alias("is_suspicious"),
        F.when(F.col("is_fraud") == 1, _pick(EXTERNAL_FRAUD_TYPOLOGIES, F.floor(h / 100000))).otherwise("unknown").alias("typology"))


def build_alerts_min(customers: DataFrame) -> DataFrame:
    """One alert per flagged customer with a running id."""
    f = customers.filter(F.col("is_suspicious")).select("customer_id", "typology")
    return consecutive_index(f, ["customer_id"], "alert_id").select("alert_id", "customer_id",
                                                                    F.col("typology").alias("alert_type"))


# ------------------------------------------------------------------ S11 / S12
def export_alert_transactions(alert_txns: DataFrame, path: str) -> None:
    """One CSV folder per alert (partitioned write, header). An alert's rows are brought together first,
    since every task that holds some of them writes a file of its own; one with very many rows is split again."""
    together = alert_txns.hint("rebalance", "alert_id")
    together.write.mode("overwrite").partitionBy("alert_id").option("header", True).csv(path)


def read_alert_transactions(spark, path: str, columns: T.StructType) -> DataFrame:
    """S11's folders read back; ``columns`` are those of the files. With them given, the folders are listed once and
    not again for a header, and by as many tasks as run at a time, not by up to 10,000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.schema(columns).option("header", True).csv(path)
    finally:
        spark.conf.set(key, before)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count (union of counts)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


# ------------------------------------------------------------------ S10
def write_stage_outputs(outputs: dict[str, DataFrame], base_path: str, run_date: str, fmt: str = "parquet") -> None:
    """Each stage table written under ``base_path/<name>/run_date=<d>``
    (overwrite of that run's partition only)."""
    for name, df in outputs.items():
        (df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").format(fmt)
         .save(f"{base_path.rstrip('/')}/{name}"))

"""S01 and the canonical views built from the driver tables (FIXTURES.md §2).

Every view is a lazy DataFrame over the Parquet scans, so Catalyst prunes the
columns and pushes the filters of whatever operator consumes it.  Time is
carried twice: ``transaction_date`` (TIMESTAMP, UTC) for display and ``ts_us``
(epoch microseconds, BIGINT) for all window arithmetic.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions.exprs import attach_scalars

from driftwatch.functions import dims
from driftwatch.functions.exprs import (US_PER_DAY, hash_int, lookup, pick,
                                        ts_micros)
from driftwatch.session import ensure_utc

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory."""
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """An optional table; a missing path gives an empty frame of the schema."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except Exception as exc:  # path absent
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def _country_of_nation(nationkey) -> F.Column:
    return pick(dims.NATION_COUNTRY, nationkey)


def _currency_of_country(country) -> F.Column:
    return lookup(dims.COUNTRY_CURRENCY_MAP, country, dims.DEFAULT_CURRENCY)


def _rate_of_currency(currency) -> F.Column:
    return lookup(dims.FX_RATES, currency, 1.0)


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank-like transactions from lineitem ⋈ orders ⋈ supplier.

    lineitem⋈orders is a large equi-join on the order key (sort-merge at
    scale); supplier is left to the planner, which broadcasts it only while
    its measured size is under ``autoBroadcastJoinThreshold``.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    df = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)

    is_crypto = (F.col("l_partkey") % 6) == 5
    asset = F.when(is_crypto, pick(dims.CRYPTO_ASSETS, F.col("l_suppkey") % 3))
    country = _country_of_nation(F.col("s_nationkey"))
    # exact integer money arithmetic: price cents * (100 - discount points), half-up
    cents = F.expr("(cast(round(l_extendedprice * 100) as bigint) * "
                   "(100 - cast(round(l_discount * 100) as bigint)) + 50) div 100")
    df = df.withColumn("_cents0", cents)
    cents = F.when(F.col("l_partkey") % 20 == 0, F.expr("((_cents0 + 5000) div 10000) * 10000")) \
        .otherwise(F.col("_cents0"))
    rate_int = F.when(asset == "BTC", F.lit(65000)).when(asset == "ETH", F.lit(3400)).otherwise(F.lit(1)).cast("long")
    ts_us = (ts_micros("l_shipdate") + (F.col("l_partkey") % 24) * 3_600_000_000
             + (F.col("l_suppkey") % 60) * 60_000_000)
    return _tx_orders_select(df, is_crypto, asset, country, cents, rate_int, ts_us)


def _tx_orders_select(df, is_crypto, asset, country, cents, rate_int, ts_us) -> DataFrame:
    df = df.withColumn("_cents", cents).withColumn("_rate", rate_int)
    amount = F.when(is_crypto, F.expr("(_cents * 1000000 + _rate div 2) div _rate") / 1e8) \
        .otherwise(F.col("_cents") / 100.0)
    currency = F.coalesce(asset, _currency_of_country(country))
    usd_rate = F.when(asset.isNotNull(), lookup(dims.CRYPTO_RATES_USD, asset, 1.0)) \
        .otherwise(_rate_of_currency(_currency_of_country(country)))
    cp = (F.when(F.col("l_partkey") % 13 == 0, F.lit(None).cast("string"))
          .when(F.col("l_partkey") % 13 == 1, F.lit(""))
          .otherwise(F.col("s_name")))
    location = F.when(is_crypto, pick(dims.CRYPTO_EXCHANGES, F.col("l_suppkey") % 10)) \
        .otherwise(F.concat(F.lit("branch_"), (F.col("l_suppkey") % 20).cast("string")))
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.col("l_quantity").cast("int"),
                    F.col("l_shipdate").cast("date").cast("string")).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.timestamp_micros(ts_us).alias("transaction_date"),
        ts_us.alias("ts_us"),
        F.when(F.col("l_linestatus") == "O", "deposit").otherwise("withdrawal").alias("transaction_type"),
        amount.alias("amount"),
        currency.alias("currency"),
        usd_rate.alias("usd_rate"),
        pick(dims.METHODS, F.col("l_partkey") % 6).alias("method"),
        location.alias("location"),
        cp.alias("counterparty"),
        country.alias("country"),
        asset.alias("crypto_asset"),
        # fixture keys kept for derived views (graph targets, chain hops)
        F.col("l_partkey").alias("src_partkey"),
        F.col("l_suppkey").alias("src_suppkey"),
        F.col("l_linenumber").alias("src_linenumber"),
        F.col("l_quantity").alias("src_quantity"),
        F.col("l_extendedprice").alias("src_price"),
    )


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursty transactions from the ``events`` table."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    ts_us = ts_micros("ts")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.timestamp_micros(ts_us).alias("transaction_date"),
        ts_us.alias("ts_us"),
        F.when(F.col("event_type").isin(*dims.EVENT_DEPOSIT_TYPES), "deposit")
        .otherwise("withdrawal").alias("transaction_type"),
        F.round(F.col("value") * 100, 2).alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit(1.0).alias("usd_rate"),
        pick(dims.METHODS, F.col("event_id") % 6).alias("method"),
        F.concat(F.lit("branch_"), (F.col("event_id") % 20).cast("string")).alias("location"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("cp"), k)).alias("counterparty"),
        pick(dims.EVENT_COUNTRY, F.col("event_id") % 7).alias("country"),
        F.lit(None).cast("string").alias("crypto_asset"),
    )


def customers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer dimension with the planted suspicious / gray-area labels."""
    c = read_table(spark, sf_dir, "customer")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    planted = (li.filter((F.col("l_extendedprice") >= dims.STRUCTURING_LO)
                         & (F.col("l_extendedprice") < dims.STRUCTURING_HI))
               .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
               .groupBy("o_custkey").agg(F.count("*").alias("n_band"))
               .filter(F.col("n_band") >= 3)
               .select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("_planted")))
    c = c.join(planted, "c_custkey", "left")
    susp = F.coalesce(F.col("_planted"), F.lit(False))
    gray = (~susp) & (F.col("c_custkey") % 20 == 7)
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 10 < 3, "business").otherwise("individual").alias("customer_type"),
        (F.lit(20000.0) + F.lit(10.0) * (F.col("c_acctbal") + F.lit(1000.0))).alias("annual_income"),
        F.date_sub(F.lit("1994-12-31").cast("date"), (F.col("c_custkey") % 3650).cast("int")).alias("account_open_date"),
        susp.alias("is_suspicious"),
        F.when(susp, F.lit("structuring")).alias("typology"),
        gray.alias("is_gray_area"),
        F.when(gray, pick(dims.GRAY_AREA_PROFILES, F.col("c_custkey") % 9)).alias("gray_profile"),
        F.lit("USA").alias("country"),
    )


def account_txns(spark: SparkSession, sf_dir: str, tx: DataFrame | None = None) -> DataFrame:
    """Account-to-account transfers: customer -> customer ``l_partkey % n_customers``.  The
    modulus is a one-row aggregate joined in (a scalar, not a driver round trip)."""
    tx = tx if tx is not None else tx_orders(spark, sf_dir)
    n = read_table(spark, sf_dir, "customer").agg(F.count("*").alias("_ncust"))
    return (attach_scalars(tx, n)
            .withColumn("counterparty", (F.col("src_partkey") % F.col("_ncust")).cast("string"))
            .drop("_ncust"))


def supplier_txns(spark: SparkSession, sf_dir: str, tx: DataFrame | None = None) -> DataFrame:
    """Customer -> supplier transfers (bipartite, like the native graph)."""
    return (tx if tx is not None else tx_orders(spark, sf_dir)).withColumn(
        "counterparty", F.concat(F.lit("s"), F.col("src_suppkey").cast("string")))


def chain_hops(spark: SparkSession, sf_dir: str, tx: DataFrame | None = None) -> DataFrame:
    """On-chain hops for the crypto rows of ``tx_orders``."""
    tx = (tx if tx is not None else tx_orders(spark, sf_dir)).filter(F.col("method") == "crypto_exchange")
    pattern = pick(["direct", "layered", "mixer", "peel_chain"], F.col("src_partkey") % 4)
    return tx.select(
        F.concat(F.lit("c-"), F.col("transaction_id")).alias("chain_txn_id"),
        "customer_id",
        F.concat(F.lit("w"), F.col("src_suppkey").cast("string")).alias("from_address"),
        F.concat(F.lit("w"), (F.col("src_partkey") % 50).cast("string")).alias("to_address"),
        F.col("crypto_asset").alias("asset"),
        F.col("amount"),
        F.round(F.col("amount") * 0.999, 8).alias("net_amount"),
        F.round(F.col("amount") * 0.001, 8).alias("fee_amount"),
        F.col("transaction_date").alias("timestamp"),
        F.col("ts_us"),
        F.col("src_linenumber").alias("hop_number"),
        pattern.alias("pattern_type"),
        F.col("transaction_id").alias("linked_bank_txn_id"),
        (pattern == "mixer").alias("is_mixer"),
        (F.col("src_linenumber") == 1).alias("is_cashout"),
        F.col("location").alias("exchange"),
    )


def rates_sparse(spark: SparkSession, sf_dir: str, tx: DataFrame | None = None) -> DataFrame:
    """Daily rates (long form) over the span of ``tx_orders`` with weekends
    removed: static base × (1 + ((day_of_year*7) % 11 - 5)/1000)."""
    tx = tx if tx is not None else tx_orders(spark, sf_dir)
    span = tx.agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    days = span.select(F.explode(F.sequence(
        F.timestamp_micros("lo").cast("date"), F.timestamp_micros("hi").cast("date"))).alias("date"))
    base = {**{k: v for k, v in dims.FX_RATES.items() if k != "USD"}, **dims.CRYPTO_RATES_USD}
    cur = spark.createDataFrame([(k, float(v)) for k, v in base.items()], "currency string, base double")
    d = days.filter(~F.dayofweek("date").isin(1, 7))
    return (d.crossJoin(F.broadcast(cur))
            .select("date", "currency",
                    F.round(F.col("base") * (1 + ((F.dayofyear("date") * 7) % 11 - 5) / 1000.0), 8)
                    .alias("usd_rate")))

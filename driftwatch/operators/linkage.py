"""Fiat → crypto linkage, on-chain summaries, wallets, exchanges."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions import dims
from driftwatch.functions.exprs import US_PER_DAY, lookup
from driftwatch.operators.sequence import latest_before_within

K = "customer_id"
TIERS = ["EXACT", "HIGH", "MEDIUM", "LOW"]


def _usd():
    return F.col("amount") * F.coalesce(F.col("usd_rate"), F.lit(1.0))


def purchases_and_deposits(txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """purchases = crypto-exchange withdrawals; deposits = other deposits."""
    p = txns.filter((F.col("method") == "crypto_exchange") & (F.col("transaction_type") == "withdrawal"))
    d = txns.filter((F.col("transaction_type") == "deposit") & (F.col("method") != "crypto_exchange"))
    return p, d


def link_fiat_to_crypto(txns: DataFrame, lookback_days: int = dims.LINK_WINDOW_DAYS) -> DataFrame:
    """L02 + L03: each purchase linked to the latest deposit in
    [t − lookback, t) (ties: highest transaction id), tiered by
    ``|fiat − purchase| / max(purchase, 1)`` (USD)."""
    p, d = purchases_and_deposits(txns)
    probes = p.select(K, "ts_us", F.col("transaction_id").alias("crypto_txn_id"),
                      F.timestamp_micros("ts_us").cast("date").cast("string").alias("crypto_date"),
                      F.col("crypto_asset"), F.col("amount").alias("crypto_amount"),
                      _usd().alias("_pusd"), F.col("location").alias("exchange"))
    ev = d.select(K, "ts_us", "transaction_id", "amount", "currency", "country", "counterparty",
                  _usd().alias("usd"))
    m = latest_before_within(ev, probes, K, lookback_days * US_PER_DAY, prefix="f_")
    linked = F.col("f_transaction_id").isNotNull()
    dev = F.abs(F.col("f_usd") - F.col("_pusd")) / F.greatest(F.col("_pusd"), F.lit(1.0))
    conf = (F.when(~linked, "UNLINKED").when(dev <= dims.LINK_HIGH_MAX_DEV, "HIGH")
            .when(dev <= dims.LINK_MEDIUM_MAX_DEV, "MEDIUM").otherwise("LOW"))
    return m.select(
        K, "crypto_txn_id", "crypto_date", "crypto_asset", "crypto_amount",
        F.round("_pusd", 2).alias("crypto_usd"), "exchange",
        F.col("f_transaction_id").alias("fiat_txn_id"),
        F.timestamp_micros("f_ts_us").cast("date").cast("string").alias("fiat_date"),
        F.round("f_amount", 2).alias("fiat_amount"),
        F.col("f_currency").alias("fiat_currency"),
        F.round("f_usd", 2).alias("fiat_usd"),
        F.col("f_country").alias("fiat_source_country"),
        F.col("f_counterparty").alias("fiat_counterparty"),
        conf.alias("confidence"),
        F.when(linked, F.floor((F.col("ts_us") - F.col("f_ts_us")) / F.lit(US_PER_DAY))).cast("long").alias("days_before"),
        F.when(linked, F.round(dev, 3)).alias("amount_deviation"),
    )


def known_links_fixture(links: DataFrame) -> DataFrame:
    """Ground-truth links for the fixtures: linked rows of customers with
    ``customer_id % 10 = 0``, in the exact-link shape (tier EXACT)."""
    k = links.filter((F.col(K) % 10 == 0) & (F.col("confidence") != "UNLINKED"))
    return k.select(
        K, F.lit(None).cast("string").alias("crypto_txn_id"), "crypto_date", "crypto_asset", "crypto_amount",
        F.col("fiat_usd").alias("crypto_usd"), "exchange", F.lit(None).cast("string").alias("fiat_txn_id"),
        "fiat_date", "fiat_amount", "fiat_currency", "fiat_usd", "fiat_source_country", "fiat_counterparty",
        F.lit("EXACT").alias("confidence"), F.lit(None).cast("long").alias("days_before"),
        F.lit(0.0).alias("amount_deviation"))


def resolve_links(inferred: DataFrame, known: DataFrame) -> DataFrame:
    """A customer with known links uses them only; others keep inferred."""
    rest = inferred.join(known.select(K).distinct(), K, "left_anti")
    return known.unionByName(rest)


def wallets_fixture(chain: DataFrame) -> DataFrame:
    """Wallet table from the distinct hop ends of each customer: entry point =
    sender of a first hop, cash-out point = receiver of a cash-out hop;
    exchange name and risk from the hop's exchange."""
    ends = (chain.select(K, F.col("from_address").alias("address"), "asset", "exchange",
                         (F.col("hop_number") == 1).alias("_entry"), F.lit(False).alias("_cash"))
            .unionByName(chain.select(K, F.col("to_address").alias("address"), "asset", "exchange",
                                      F.lit(False).alias("_entry"), F.col("is_cashout").alias("_cash"))))
    w = ends.groupBy(K, "address").agg(
        F.min("asset").alias("asset"), F.max("_entry").alias("is_entry_point"),
        F.max("_cash").alias("is_cashout_point"), F.min("exchange").alias("_ex"))
    is_ex = F.col("is_entry_point") | F.col("is_cashout_point")
    risk = F.when(is_ex, lookup({k: v[0] for k, v in dims.EXCHANGE_PROFILES.items()}, F.col("_ex"), 0.0)).otherwise(0.0)
    return w.select(
        F.concat_ws(":", F.col(K).cast("string"), "address").alias("wallet_id"), K, "address", "asset",
        F.when(is_ex, "exchange_hot_wallet").otherwise("private").alias("entity_type"),
        F.when(is_ex, F.col("_ex")).alias("exchange_name"), risk.alias("risk_score"),
        "is_entry_point", "is_cashout_point")


def chain_summary(chain: DataFrame, wallets: DataFrame) -> DataFrame:
    """L05 per customer: hops, distinct patterns, mixer / cash-out hops,
    distinct wallets over both ends, fees, entry and exit exchanges and those
    with risk ≥ 0.50."""
    ends = chain.select(K, F.col("from_address").alias("a")).unionByName(chain.select(K, F.col("to_address").alias("a")))
    nw = ends.groupBy(K).agg(F.count_distinct("a").alias("unique_wallets"))
    h = chain.groupBy(K).agg(
        F.count("*").alias("total_hops"),
        F.sort_array(F.collect_set("pattern_type")).alias("patterns_used"),
        F.count(F.when(F.col("is_mixer"), 1)).alias("mixer_hops"),
        F.count(F.when(F.col("is_cashout"), 1)).alias("cashout_hops"),
        F.round(F.sum("fee_amount"), 8).alias("total_fees_crypto"))
    risk = lookup({k: v[0] for k, v in dims.EXCHANGE_PROFILES.items()}, F.col("exchange_name"), 0.0)
    ex = wallets.filter(F.col("exchange_name").isNotNull()).groupBy(K).agg(
        F.sort_array(F.collect_set(F.when(F.col("is_entry_point"), F.col("exchange_name")))).alias("entry_exchanges"),
        F.sort_array(F.collect_set(F.when(F.col("is_cashout_point"), F.col("exchange_name")))).alias("cashout_exchanges"),
        F.sort_array(F.collect_set(F.when((F.col("is_entry_point") | F.col("is_cashout_point"))
                                          & (risk >= dims.HIGH_RISK_EXCHANGE_MIN), F.col("exchange_name")))).alias("high_risk_exchanges"))
    empty = F.array().cast("array<string>")
    return (h.join(nw, K).join(ex, K, "left")
            .select(K, "total_hops", "unique_wallets", "patterns_used", "mixer_hops", "cashout_hops",
                    "total_fees_crypto",
                    *[F.coalesce(c, empty).alias(c) for c in ("entry_exchanges", "cashout_exchanges", "high_risk_exchanges")]))


def flow_summary(links: DataFrame, chain_sum: DataFrame | None = None) -> DataFrame:
    """L06 per customer: linked (tier ≠ UNLINKED) and unlinked counts, counts
    per tier, USD totals of purchases and linked fiat, source countries and
    currencies (sorted, distinct), up to four counterparties, and whether the
    entry and exit exchanges differ."""
    linked = F.col("confidence") != "UNLINKED"
    s = links.groupBy(K).agg(
        F.count(F.when(linked, 1)).alias("linked"),
        F.count(F.when(~linked, 1)).alias("unlinked"),
        *[F.count(F.when(F.col("confidence") == t, 1)).alias(f"n_{t.lower()}") for t in TIERS],
        F.sum("crypto_usd").alias("crypto_usd_total"),
        F.sum(F.when(linked, F.col("fiat_usd"))).alias("fiat_usd_total"),
        F.sort_array(F.collect_set(F.when(linked, F.col("fiat_source_country")))).alias("source_countries"),
        F.sort_array(F.collect_set(F.when(linked, F.col("fiat_currency")))).alias("fiat_currencies"),
        F.sort_array(F.collect_set(F.when(linked & F.col("fiat_counterparty").isNotNull()
                                          & (F.col("fiat_counterparty") != ""), F.col("fiat_counterparty")))).alias("_cps"),
        F.max_by("fiat_source_country", F.when(linked, F.col("fiat_usd"))).alias("top_source_country"),
    ).withColumn("counterparties", F.slice("_cps", 1, 4)).drop("_cps")
    if chain_sum is not None:
        s = s.join(chain_sum.select(K, "entry_exchanges", "cashout_exchanges"), K, "left").withColumn(
            "entry_differs_from_exit", F.coalesce(F.col("entry_exchanges") != F.col("cashout_exchanges"), F.lit(False))
        ).drop("entry_exchanges", "cashout_exchanges")
    return s


def source_of_funds_text(flow: DataFrame) -> DataFrame:
    """The 'source of fiat funds' paragraph per customer."""
    txt = F.concat(
        F.lit("SOURCE OF FIAT FUNDS: "),
        F.format_string("%d of %d crypto purchases were linked to prior fiat deposits "
                        "(%d exact, %d high, %d medium, %d low confidence). ",
                        F.col("linked"), F.col("linked") + F.col("unlinked"), F.col("n_exact"),
                        F.col("n_high"), F.col("n_medium"), F.col("n_low")),
        F.format_string("Linked fiat totals $%s USD against $%s USD of purchases. ",
                        F.format_number(F.coalesce("fiat_usd_total", F.lit(0.0)), 2),
                        F.format_number(F.coalesce("crypto_usd_total", F.lit(0.0)), 2)),
        F.when(F.size("source_countries") > 0,
               F.concat(F.lit("Funds originated from: "), F.array_join("source_countries", ", "), F.lit(". ")))
        .otherwise(F.lit("")),
        F.when(F.size("counterparties") > 0,
               F.concat(F.lit("Counterparties: "), F.array_join("counterparties", ", "), F.lit(".")))
        .otherwise(F.lit("")),
    )
    return flow.select(K, F.trim(txt).alias("source_of_funds"))


def wallet_totals(chain: DataFrame, wallets: DataFrame) -> DataFrame:
    """L08 + L09: received (net) by to-address, sent by from-address, first and
    last seen over both ends."""
    rec = chain.groupBy(K, F.col("to_address").alias("address")).agg(F.sum("net_amount").alias("total_received"))
    snt = chain.groupBy(K, F.col("from_address").alias("address")).agg(F.sum("amount").alias("total_sent"))
    seen = (chain.select(K, F.col("from_address").alias("address"), "ts_us")
            .unionByName(chain.select(K, F.col("to_address").alias("address"), "ts_us"))
            .groupBy(K, "address").agg(F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us")))
    return (wallets.join(rec, [K, "address"], "left").join(snt, [K, "address"], "left")
            .join(seen, [K, "address"], "left")
            .fillna({"total_received": 0.0, "total_sent": 0.0}))


def exchange_risk(df: DataFrame, col: str = "exchange") -> DataFrame:
    """Exchange risk score, KYC level, jurisdiction and risk band."""
    r = lookup({k: v[0] for k, v in dims.EXCHANGE_PROFILES.items()}, F.col(col))
    return df.select("*", r.alias("exchange_risk"),
                     lookup({k: v[1] for k, v in dims.EXCHANGE_PROFILES.items()}, F.col(col)).alias("kyc_level"),
                     lookup({k: v[2] for k, v in dims.EXCHANGE_PROFILES.items()}, F.col(col)).alias("jurisdiction"),
                     F.when(r >= dims.HIGH_RISK_EXCHANGE_MIN, "high").when(r < dims.LOW_RISK_EXCHANGE_MAX, "low")
                     .when(r.isNotNull(), "medium").alias("risk_band"))

"""Daily rates, densification and as-of conversion to USD.

Rates are a long table ``rates(date, currency, usd_rate)``.  Its size is days
× currencies, which does not grow with the transactions; the join to the
transactions is an equi-join on (currency, date) after densification, so a
"latest prior date" lookup never needs a range join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions import dims

STATIC = {**dims.FX_RATES, **dims.CRYPTO_RATES_USD}


def static_rates(spark, start: str, end: str) -> DataFrame:
    """The static table for every day in [start, end] and currency."""
    cur = spark.createDataFrame([(k, float(v)) for k, v in STATIC.items()], "currency string, usd_rate double")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.crossJoin(F.broadcast(cur))


def densify_rates(sparse: DataFrame, start: str | None = None, end: str | None = None,
                  back_fill: bool = True) -> DataFrame:
    """Calendar × currency, forward fill then back fill; USD = 1.

    The calendar is ``sequence(start, end)`` (defaults: the sparse table's
    span); each currency's fill is a running ``last(ignorenulls)`` window
    over its own days."""
    bounds = sparse.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    lo = F.lit(start).cast("date") if start else F.col("_lo")
    hi = F.lit(end).cast("date") if end else F.col("_hi")
    days = bounds.select(F.explode(F.sequence(lo, hi)).alias("date"))
    cur = sparse.select("currency").filter(F.col("currency") != "USD").distinct()
    grid = days.crossJoin(cur)  # days × currencies: fixed by the calendar, not by data volume
    g = grid.join(sparse.select("date", "currency", "usd_rate"), ["date", "currency"], "left")
    w_f = Window.partitionBy("currency").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("usd_rate", F.last("usd_rate", ignorenulls=True).over(w_f))
    if back_fill:
        w_b = Window.partitionBy("currency").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
        g = g.withColumn("usd_rate", F.coalesce("usd_rate", F.first("usd_rate", ignorenulls=True).over(w_b)))
    usd = days.select("date", F.lit("USD").alias("currency"), F.lit(1.0).alias("usd_rate"))
    return g.unionByName(usd)


def rate_as_of(txns: DataFrame, sparse: DataFrame, date_col: str = "transaction_date",
               currency_col: str = "currency", out: str = "usd_rate_asof") -> DataFrame:
    """USD → 1.0; else the rate of the exact date, else of the latest
    prior date; before the first rate, the static table; unknown → 1.0.

    Forward-filled densification from the first rate date to the last
    transaction date turns "latest prior" into an equi-join."""
    t = txns.withColumn("_d", F.col(date_col).cast("date"))
    hi = t.agg(F.max("_d").alias("_hi"))
    first = sparse.groupBy("currency").agg(F.min("date").alias("_first"))
    dense = densify_rates(sparse.unionByName(
        hi.crossJoin(first.select("currency")).select(F.col("_hi").alias("date"), "currency",
                                                       F.lit(None).cast("double").alias("usd_rate"))),
        back_fill=False)
    j = t.join(dense.withColumnRenamed("date", "_d").withColumnRenamed("currency", currency_col)
               .withColumnRenamed("usd_rate", "_r"), ["_d", currency_col], "left")
    static = F.create_map(*[x for k, v in STATIC.items() for x in (F.lit(k), F.lit(float(v)))])
    rate = (F.when(F.col(currency_col) == "USD", F.lit(1.0))
            .otherwise(F.coalesce("_r", F.try_element_at(static, F.col(currency_col)), F.lit(1.0))))
    return j.withColumn(out, rate).drop("_d", "_r")


def to_usd(amount, rate) -> F.Column:
    """Amount × rate rounded to 6."""
    return F.round(amount * rate, 6)


def currency_for_country(country) -> F.Column:
    """Country → currency (default USD)."""
    m = F.create_map(*[x for k, v in dims.COUNTRY_CURRENCY_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, country), F.lit(dims.DEFAULT_CURRENCY))


def price_level(country) -> F.Column:
    """Country → PPP price level (default 0.60)."""
    m = F.create_map(*[x for k, v in dims.COUNTRY_PPL.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, country), F.lit(dims.DEFAULT_PPL))


def cache_covers(rates: DataFrame, start: str, end: str) -> DataFrame:
    """One row, whether the table covers [start, end]."""
    return rates.agg(((F.min("date") <= F.lit(start).cast("date"))
                      & (F.max("date") >= F.lit(end).cast("date"))).alias("covers"),
                     F.min("date").alias("first_date"), F.max("date").alias("last_date"))

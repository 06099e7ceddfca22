"""Behavioural signals per customer.

Input is a transactions frame with ``customer_id, ts_us, amount, counterparty``.
All signals are built from grouped aggregates: counts per (customer, window,
category) feed entropies, closed-form moments feed slopes. Raw rows are dealt by
(customer, day); what a customer's history says of them (anchors of windows, the row
before a day, amount bounds of a window) is merged from summaries of days and goes
back by (customer, day), so raw rows never meet by customer alone.
No per-customer Python, no collect.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions import dims
from driftwatch.functions.exprs import (US_PER_DAY, US_PER_HOUR, day_number,
                                        entropy_agg, weekday_from_us)
from driftwatch.session import stored

K = "customer_id"

ENTROPY_COLS = ["amount_entropy_drift", "timing_entropy_drift", "counterparty_entropy_drift",
                "mean_amount_entropy", "mean_timing_entropy", "mean_counterparty_entropy"]
BURST_COLS = ["burstiness_index", "burst_events", "inter_arrival_variance",
              "max_daily_count", "mean_daily_count"]
EXPANSION_COLS = ["counterparty_expansion_rate", "counterparty_novelty_slope",
                  "total_unique_counterparties"]
AMOUNT_COLS = ["benford_deviation", "structuring_score", "round_amount_ratio",
               "amount_skewness", "amount_kurtosis"]
SIGNAL_COLS = ENTROPY_COLS + BURST_COLS + EXPANSION_COLS + AMOUNT_COLS


def valid_counterparty(c="counterparty") -> F.Column:
    """Null and '' are missing counterparties."""
    return F.col(c).isNotNull() & (F.col(c) != "")


# ------------------------------------------------- rows and what their customer's history says
CELL = "_cell"


def with_history(df: DataFrame) -> DataFrame:
    """Rows with their UTC day (``_cell``) and facts of their customer's whole history:
    first and last time (``_min``, ``_max``), rows (``_n``), active days (``_days``) and
    rows of the fullest one (``_maxd``), the last time before the row's day (``_before``),
    and first, last and number of the rows with a valid counterparty (``_vmin``, ``_vmax``, ``_nv``).

    A day's rows become one summary before they are dealt; the summaries of a customer (one per
    active day) meet in a window and go back to the rows by (customer, day). Raw rows are never
    dealt by customer alone: one that holds a third of all rows is as many keys as it has days."""
    valid = F.when(valid_counterparty(), F.col("ts_us")) if "counterparty" in df.columns else F.lit(None).cast("long")
    d = df.withColumn(CELL, day_number("ts_us"))
    days = d.groupBy(K, CELL).agg(
        F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"), F.count("*").alias("_rows"),
        F.min(valid).alias("_vfirst"), F.max(valid).alias("_vlast"), F.count(valid).alias("_vrows"))
    whole = Window.partitionBy(K)
    history = days.select(
        K, CELL, F.min("_first").over(whole).alias("_min"), F.max("_last").over(whole).alias("_max"),
        F.sum("_rows").over(whole).alias("_n"), F.count("*").over(whole).alias("_days"), F.max("_rows").over(whole).alias("_maxd"),
        F.lag("_last").over(whole.orderBy(CELL)).alias("_before"),
        F.min("_vfirst").over(whole).alias("_vmin"), F.max("_vlast").over(whole).alias("_vmax"), F.sum("_vrows").over(whole).alias("_nv"))
    return d.join(stored(history, "signals"), [K, CELL])


# --------------------------------------------------------------------- B01–B04
def grouped_entropies(df: DataFrame, keys: list[str]) -> DataFrame:
    """B01–B04 for every group of ``keys`` (the customer, and whatever splits its rows):
    amount (10 bins on [min, max+1)), weekday and counterparty entropy with their
    small-sample guards.

    A group's bounds are taken with its days (no more than the group is long) and go back to
    the amounts by (group, day); their bins are counted and written before the other two kinds
    are counted at once (rows stacked as (kind, category)), so that their shuffles are gone by then."""
    d = df if CELL in df.columns else df.withColumn(CELL, day_number("ts_us"))
    mm = d.groupBy(*keys).agg(F.min("amount").alias("_amin"), F.max("amount").alias("_amax"), F.collect_set(CELL).alias("_cells"))
    mm = mm.select(*keys, "_amin", "_amax", F.explode("_cells").alias(CELL))
    width = (F.col("_amax") + 1) - F.col("_amin")
    abin = F.least(F.lit(9), F.floor((F.col("amount") - F.col("_amin")) / width * 10)).cast("string")
    kinds = lambda long: long.filter(F.col("cat").isNotNull()).groupBy(*keys, "kind", "cat").agg(F.count("*").alias("n"))
    amounts = d.select(*keys, CELL, "amount").join(mm, [*keys, CELL]).select(*keys, F.lit("a").alias("kind"), abin.alias("cat"))
    cats = F.array(
        F.struct(F.lit("t").alias("kind"), weekday_from_us("ts_us").cast("string").alias("cat")),
        F.struct(F.lit("c").alias("kind"),
                 F.when(valid_counterparty(), F.col("counterparty")).alias("cat")),
    )
    others = d.dropna(subset=[*keys, CELL]).select(*keys, F.explode(cats).alias("kc")).select(*keys, "kc.kind", "kc.cat")
    counts = stored(kinds(amounts), "signals").unionByName(kinds(others))

    def of(kind: str, name: str) -> F.Column:
        """0 with fewer than two rows (counterparty: valid rows)."""
        n = F.when(F.col("kind") == kind, F.col("n"))
        return F.when(F.sum(n) >= 2, entropy_agg(n)).otherwise(F.lit(0.0)).alias(name)
    return counts.groupBy(*keys).agg(of("a", "amount_entropy"), of("t", "timing_entropy"), of("c", "counterparty_entropy"))


# --------------------------------------------------------------------- B05–B06
def _window_index(window_days: int) -> F.Column:
    w_us = window_days * US_PER_DAY
    k = F.floor((F.col("ts_us") - F.col("_min")) / F.lit(w_us)).cast("long")
    short = F.floor((F.col("_max") - F.col("_min")) / F.lit(US_PER_DAY)) < 2 * window_days
    complete = F.col("_min") + (k + 1) * F.lit(w_us) <= F.col("_max")
    return F.when(short, F.lit(-1)).when(complete, k)


def tumbling_window_index(df: DataFrame, window_days: int = dims.ROLLING_WINDOW_DAYS) -> DataFrame:
    """Window index anchored at each customer's first row; only complete
    windows (``start + w <= max``) keep an index.  Histories shorter than two
    windows (whole days) get the single index -1 over all their rows."""
    return with_history(df).withColumn("win", _window_index(window_days)).select(*df.columns, "win")


def entropy_drift(df: DataFrame, window_days: int = dims.ROLLING_WINDOW_DAYS) -> DataFrame:
    """Per-window B02–B04, drift = largest absolute step between
    consecutive non-empty windows, means over windows, ``num_windows``."""
    return _entropy_drift(with_history(df), window_days)


def _entropy_drift(rows: DataFrame, window_days: int) -> DataFrame:
    d = rows.withColumn("win", _window_index(window_days)).filter(F.col("win").isNotNull())
    per_win = grouped_entropies(d.select(K, CELL, "ts_us", "amount", "counterparty", "win"), [K, "win"])
    w = Window.partitionBy(K).orderBy("win")  # a few rows per customer
    kinds = ["amount", "timing", "counterparty"]
    for kd in kinds:
        per_win = per_win.withColumn(f"_d_{kd}", F.abs(F.col(f"{kd}_entropy") - F.lag(f"{kd}_entropy").over(w)))
    agg = per_win.groupBy(K).agg(
        *[F.coalesce(F.max(f"_d_{kd}"), F.lit(0.0)).alias(f"{kd}_entropy_drift") for kd in kinds],
        *[F.avg(f"{kd}_entropy").alias(f"mean_{kd}_entropy") for kd in kinds],
        F.count("*").alias("num_windows"),
        F.max(F.col("win") == -1).alias("_short"),
    )
    return agg.select(K, *ENTROPY_COLS, F.col("amount_entropy_drift").alias("entropy_drift"),
                      F.when(F.col("_short"), F.lit(1)).otherwise(F.col("num_windows")).cast("long").alias("num_windows"))


# ------------------------------------------------------------------------- B07
def _gap_hours() -> F.Column:
    """Hours since the customer's previous row: the row before it on its day, else the last one of an earlier day."""
    previous = F.coalesce(F.lag("ts_us").over(Window.partitionBy(K, CELL).orderBy("ts_us")), F.col("_before"))
    return (F.col("ts_us") - previous) / F.lit(float(US_PER_HOUR))


def _burst_aggregates() -> list[F.Column]:
    """Over rows of ``with_history`` with their ``_gap``."""
    return [F.avg("_gap").alias("_m"), F.stddev_samp("_gap").alias("_s"), F.var_samp("_gap").alias("_v"),
            F.count(F.when(F.col("_gap") < 24, 1)).alias("_b"), F.max("_n").alias("_rows"),
            F.max("_maxd").alias("_maxd"), F.max("_days").alias("_days")]


def _burst_columns() -> list[F.Column]:
    ok = F.col("_rows") >= 3
    denom = F.col("_s") + F.col("_m")
    burst = F.when(denom > 0, (F.col("_s") - F.col("_m")) / denom).otherwise(F.lit(0.0))
    return [
        F.when(ok, F.coalesce(burst, F.lit(0.0))).otherwise(F.lit(0.0)).alias("burstiness_index"),
        F.when(ok, F.col("_b")).otherwise(F.lit(0)).cast("long").alias("burst_events"),
        F.when(ok, F.coalesce(F.col("_v"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("inter_arrival_variance"),
        F.when(ok, F.col("_maxd")).otherwise(F.lit(0)).cast("long").alias("max_daily_count"),
        F.when(ok, F.col("_rows") / F.col("_days")).otherwise(F.lit(0.0)).alias("mean_daily_count"),
    ]


def temporal_burst(df: DataFrame) -> DataFrame:
    """Inter-arrival statistics in hours (sample std/var), bursts < 24 h,
    max and mean rows per calendar day; fewer than 3 rows -> zeros."""
    g = with_history(df.select(K, "ts_us")).withColumn("_gap", _gap_hours())
    return g.groupBy(K).agg(*_burst_aggregates()).select(K, *_burst_columns())


# ------------------------------------------------------------------------- B08
def counterparty_expansion(df: DataFrame, window_days: int = dims.ROLLING_WINDOW_DAYS) -> DataFrame:
    """First-seen window of each valid counterparty, anchored at the
    customer's first valid row; windows run while ``start + w <= max + 1 day``
    (empty ones count as 0).  Slope is the OLS slope over window indices,
    written in closed form so empty windows need no densifying."""
    return _expansion(with_history(df.select(K, "ts_us", "counterparty")), window_days)


def _expansion(rows: DataFrame, window_days: int) -> DataFrame:
    w_us = window_days * US_PER_DAY
    nwin = F.floor((F.col("_vmax") + F.lit(US_PER_DAY) - F.col("_vmin")) / F.lit(w_us)).cast("long")
    seen = F.when(valid_counterparty(), F.floor((F.col("ts_us") - F.col("_vmin")) / F.lit(w_us)).cast("long"))
    # rows without a valid counterparty are one group, whose _k is null
    first = rows.groupBy(K, F.when(valid_counterparty(), F.col("counterparty")).alias("_cp")).agg(
        F.min(seen).alias("_k"), F.max(nwin).alias("_nwin"), F.max("_n").alias("_rows"), F.max("_nv").alias("_nv"))
    new = F.when(F.col("_k") < F.col("_nwin"), F.col("_k"))
    s = first.groupBy(K).agg(F.count(new).alias("_tot"), F.sum(new).alias("_sxy"), F.max("_nwin").alias("_nwin"),
                             F.max("_rows").alias("_rows"), F.max("_nv").alias("_nv"))
    kk = F.col("_nwin").cast("double")
    tot = F.col("_tot").cast("double")
    sxy = F.coalesce(F.col("_sxy"), F.lit(0)).cast("double")
    xbar = (kk - 1) / 2
    slope = (sxy - xbar * tot) / (kk * (kk * kk - 1) / 12)
    ok = (F.col("_rows") >= 2) & (F.col("_nv") >= 2) & (F.col("_nwin") >= 1)
    return s.select(
        K,
        F.when(ok, tot / kk).otherwise(F.lit(0.0)).alias("counterparty_expansion_rate"),
        F.when(ok & (F.col("_nwin") >= 2), slope).otherwise(F.lit(0.0)).alias("counterparty_novelty_slope"),
        F.when(ok, tot).otherwise(F.lit(0.0)).cast("long").alias("total_unique_counterparties"),
    )


# --------------------------------------------------------------------- B09–B13
_BENFORD = [(d, math.log10(1 + 1 / d)) for d in range(1, 10)]


def _amount_aggregates() -> list[F.Column]:
    """The nine first digits are nine counters, so one partial aggregate per customer is all that is dealt."""
    amount = F.when(F.col("amount") > 0, F.col("amount"))
    digit = F.regexp_extract(amount.cast("string"), "[1-9]", 0)
    return [
        F.count("*").alias("_na"), F.count(amount).alias("_np"),
        F.count(F.when((amount >= dims.STRUCTURING_LO) & (amount < dims.STRUCTURING_HI), 1)).alias("_ns"),
        F.count(F.when((amount % 100 == 0) | (amount % 1000 == 0), 1)).alias("_nr"),
        F.skewness(amount).alias("_skew"), F.kurtosis(amount).alias("_kurt"), F.stddev_pop(amount).alias("_sd"),
        *[F.count(F.when(digit == str(d), 1)).alias(f"_d{d}") for d, _ in _BENFORD]]


def _amount_columns() -> list[F.Column]:
    digits = sum((F.col(f"_d{d}") for d, _ in _BENFORD[1:]), F.col("_d1"))
    parts = [F.when(F.col(f"_d{d}") > 0, F.abs(F.col(f"_d{d}") / digits - e) - e).otherwise(0.0) for d, e in _BENFORD]
    benford = F.when(digits > 0, F.lit(1.0) + sum(parts[1:], parts[0])).otherwise(0.0)
    ok = (F.col("_na") >= 5) & (F.col("_np") >= 5)
    const = F.col("_sd") == 0

    def g(x):
        return F.when(ok, x).otherwise(F.lit(0.0))
    return [
        g(benford).alias("benford_deviation"),
        g(F.col("_ns") / F.col("_np")).alias("structuring_score"),
        g(F.col("_nr") / F.col("_np")).alias("round_amount_ratio"),
        g(F.when(const, 0.0).otherwise(F.coalesce(F.col("_skew"), F.lit(0.0)))).alias("amount_skewness"),
        g(F.when(const, 0.0).otherwise(F.coalesce(F.col("_kurt"), F.lit(0.0)))).alias("amount_kurtosis"),
    ]


def amount_anomaly(df: DataFrame) -> DataFrame:
    """B09–B13 over positive amounts: Benford L1 deviation, structuring share
    [7000, 10000), round-hundred share, population skewness and excess
    kurtosis; fewer than 5 rows or 5 positive amounts -> zeros.

    Benford uses 1 + sum over present digits of (|p_d - e_d| - e_d), which is
    the 9-term L1 sum since the expected shares add up to 1."""
    return df.groupBy(K).agg(*_amount_aggregates()).select(K, *_amount_columns())


# ------------------------------------------------------------------------- B14
def all_signals(txns: DataFrame, customers: DataFrame | None = None, min_rows: int = 1,
                window_days: int = dims.ROLLING_WINDOW_DAYS) -> DataFrame:
    """The 19 behavioural columns per customer with at least ``min_rows``
    rows (customers without rows are skipped). The rows with their customer's history are
    written once; all signals are partial aggregates over them, written one after the other, so that the
    shuffles of one are gone before the next. Only per-customer results meet by customer."""
    rows = with_history(txns.select(K, "ts_us", "amount", "counterparty")).where(F.col("_n") >= min_rows)
    rows = stored(rows.withColumn("_gap", _gap_hours()).drop("_before"), "signals")
    both = rows.groupBy(K).agg(*_burst_aggregates(), *_amount_aggregates())
    parts = [both.select(K, *_burst_columns(), *_amount_columns()),
             _entropy_drift(rows, window_days).select(K, *ENTROPY_COLS), _expansion(rows, window_days)]
    merged = None
    for part in parts:
        part = stored(part, "signals")
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    # a customer has one row in each part; those missing in one are left out
    out = merged.groupBy(K).agg(F.count("*").alias("_parts"), *[F.max(c).alias(c) for c in SIGNAL_COLS])
    out = out.filter(F.col("_parts") == len(parts))
    if customers is not None:
        out = out.join(customers.select(K), K, "left_semi")
    return out.select(K, *SIGNAL_COLS)

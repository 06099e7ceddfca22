"""I01–I05 behavioural stability index, M01–M03 monitoring levels."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.exprs import attach_scalars

from driftwatch.functions import dims
from driftwatch.functions.exprs import normalize
from driftwatch.session import stored

K = "customer_id"

DIMENSIONS = ["entropy_stability", "temporal_stability", "counterparty_stability",
              "amount_stability", "network_stability"]


def dround(c, digits: int) -> F.Column:
    """Half-up rounding of the shortest decimal form (DuckDB's ``round`` agrees)."""
    return F.round(c, digits)


def _g(name: str, default: float = 0.0) -> F.Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def drift_level(score) -> F.Column:
    """≤25 critical, ≤50 high, ≤75 moderate, else stable."""
    return (F.when(score <= dims.BSI_CRITICAL, "critical")
            .when(score <= dims.BSI_HIGH_DRIFT, "high")
            .when(score <= dims.BSI_MODERATE, "moderate")
            .otherwise("stable"))


def bsi_dimensions(signals: DataFrame) -> DataFrame:
    """The five dimension scores and the raw index from one row of merged
    behavioural + graph signals (missing inputs 0, funnel_ratio 1)."""
    avg_drift = (_g("amount_entropy_drift") + _g("timing_entropy_drift") + _g("counterparty_entropy_drift")) / 3
    entropy = 1 - normalize(avg_drift, 0, 2.0)
    temporal = ((1 - normalize(F.greatest(_g("burstiness_index"), F.lit(0.0)), 0, 1.0)) * 0.4
                + (1 - normalize(_g("burst_events"), 0, 30)) * 0.3
                + (1 - normalize(_g("max_daily_count"), 0, 15)) * 0.3)
    cp = ((1 - normalize(_g("counterparty_expansion_rate"), 0, 15)) * 0.4
          + (1 - normalize(F.abs(_g("counterparty_novelty_slope")), 0, 3)) * 0.3
          + (1 - normalize(_g("total_unique_counterparties"), 0, 80)) * 0.3)
    amount = 1 - (normalize(_g("benford_deviation"), 0, 1.5) * 0.3
                  + normalize(_g("structuring_score"), 0, 0.3) * 0.3
                  + normalize(F.abs(_g("amount_skewness")), 0, 5) * 0.2
                  + normalize(F.abs(_g("amount_kurtosis")), 0, 20) * 0.2)
    circ = F.when(F.coalesce(F.col("has_circular_flow").cast("boolean"), F.lit(False)), 1.0).otherwise(0.0)
    funnel = F.when(F.coalesce(F.col("is_funnel_hub").cast("boolean"), F.lit(False)), 1.0).otherwise(0.0)
    network = 1 - (normalize(_g("funnel_ratio", 1.0), 1, 8) * 0.2
                   + normalize(_g("layer_depth"), 0, 6) * 0.2
                   + normalize(_g("flow_velocity"), 0, 0.3) * 0.15
                   + circ * 0.15 + funnel * 0.15
                   + normalize(_g("rapid_passthrough_count"), 0, 10) * 0.15)
    raw = entropy * 0.25 + temporal * 0.20 + cp * 0.20 + amount * 0.20 + network * 0.15
    score = dround(raw * 100, 2)
    return signals.select(
        K,
        score.alias("bsi_score"),
        drift_level(score).alias("drift_level"),
        dround(entropy * 100, 2).alias("entropy_stability"),
        dround(temporal * 100, 2).alias("temporal_stability"),
        dround(cp * 100, 2).alias("counterparty_stability"),
        dround(amount * 100, 2).alias("amount_stability"),
        dround(network * 100, 2).alias("network_stability"),
    )


def bsi_raw(behavioural: DataFrame, graph: DataFrame) -> DataFrame:
    """I02 over the inner join of behavioural and graph signals."""
    return bsi_dimensions(behavioural.join(graph, K))


def bsi_rescale(bsi: DataFrame) -> DataFrame:
    """Population p5/p95 → ``(raw-p5)/(p95-p5)·90+5`` clipped to 2..98,
    rounded 2, levels recomputed; unchanged when p95 <= p5.

    The exact ``percentile`` keeps a value→count map; raw scores have two
    decimals in [0, 100], so that map is bounded by 10,001 entries whatever
    the population size.  The one-row result is broadcast (size 1)."""
    q = bsi.agg(F.percentile("bsi_score", 0.05).alias("_p5"), F.percentile("bsi_score", 0.95).alias("_p95"))
    j = attach_scalars(bsi, q)
    spread = F.col("_p95") > F.col("_p5")
    resc = dround(F.greatest(F.lit(2.0), F.least(F.lit(98.0),
                  (F.col("bsi_score") - F.col("_p5")) / (F.col("_p95") - F.col("_p5")) * 90 + 5)), 2)
    score = F.when(spread, resc).otherwise(F.col("bsi_score"))
    return (j.withColumn("bsi_score", score)
            .withColumn("drift_level", F.when(spread, drift_level(F.col("bsi_score"))).otherwise(F.col("drift_level")))
            .drop("_p5", "_p95"))


def compute_bsi(behavioural: DataFrame, graph: DataFrame) -> DataFrame:
    """I02 + I03: batch index with population rescaling."""
    return bsi_rescale(bsi_raw(behavioural, graph))


# --------------------------------------------------------------- monitoring
def _level(score, sudden) -> F.Column:
    return (F.when((score <= dims.BSI_CRITICAL) | sudden, "immediate")
            .when(score <= dims.BSI_HIGH_DRIFT, "intensive")
            .when(score <= dims.BSI_MODERATE, "enhanced")
            .otherwise("standard"))


def _level_columns(level: F.Column, sudden: F.Column) -> list:
    interval = F.create_map(*[x for k, v in dims.MONITORING_LEVELS.items() for x in (F.lit(k), F.lit(v[0]))])
    thr = F.create_map(*[x for k, v in dims.MONITORING_LEVELS.items() for x in (F.lit(k), F.lit(v[1]))])
    action = F.create_map(*[x for k, v in dims.MONITORING_LEVELS.items() for x in (F.lit(k), F.lit(v[2]))])
    return [
        level.alias("monitoring_level"),
        F.element_at(interval, level).cast("long").alias("check_interval_days"),
        F.element_at(thr, level).alias("anomaly_threshold"),
        F.element_at(action, level).alias("recommended_action"),
        sudden.alias("sudden_drop_detected"),
        (level.isin("immediate", "intensive") | sudden).alias("escalation_triggered"),
    ]


def monitoring_state(bsi: DataFrame, run_ts: str | None = None) -> DataFrame:
    """Level, interval, threshold, action, escalation per customer; the
    run timestamp is a parameter (default: the query's current_timestamp)."""
    sudden = F.lit(False)
    level = _level(F.col("bsi_score"), sudden)
    ts = F.lit(run_ts).cast("timestamp") if run_ts else F.current_timestamp()
    return bsi.select(K, *_level_columns(level, sudden), "bsi_score", "drift_level", ts.alias("timestamp"))


def sudden_drop(timeline: DataFrame, order_col: str = "window_start_us") -> DataFrame:
    """On a per-customer timeline of scores, previous score − score > 20
    forces the immediate level."""
    w = Window.partitionBy(K).orderBy(order_col)
    t = timeline.withColumn("previous_bsi", F.lag("bsi_score").over(w))
    sudden = F.coalesce((F.col("previous_bsi") - F.col("bsi_score")) > dims.SUDDEN_DROP_POINTS, F.lit(False))
    level = _level(F.col("bsi_score"), sudden)
    return t.select(*timeline.columns, "previous_bsi", *_level_columns(level, sudden))


def level_counts(monitor: DataFrame) -> DataFrame:
    """Customers per monitoring level and escalation flag."""
    return monitor.groupBy("monitoring_level", "escalation_triggered").agg(F.count("*").alias("customers"))


# ---------------------------------------------------------------- I05
def bsi_timeline(txns: DataFrame, window_days: int = 60, step_days: int = 30,
                 signal_window_days: int = dims.ROLLING_WINDOW_DAYS) -> DataFrame:
    """Sliding windows anchored at each customer's first row
    (``start + w <= max + 1 day``), customers with ≥ 5 rows, windows with ≥ 3
    rows; per window the behavioural signals, the window's own star graph and
    the raw BSI.  Each row is exploded into the ≤ ceil(w/step) windows that
    hold it, and a (customer, window) pair is scored as one entity by the
    same grouped operators.  Ids may be of any type, and a customer's anchors
    reach its rows by (customer, day)."""
    from driftwatch.functions.exprs import US_PER_DAY
    from driftwatch.operators import signals as S
    from driftwatch.operators.graph import flows as GF
    from driftwatch.operators.graph.edges import INVALID_COUNTERPARTIES
    w_us, s_us = window_days * US_PER_DAY, step_days * US_PER_DAY
    d = S.with_history(txns).filter(F.col("_n") >= 5)
    last = F.floor((F.col("ts_us") - F.col("_min")) / F.lit(s_us)).cast("long")
    per = -(-window_days // step_days)  # windows that can hold one row
    js = F.sequence(F.greatest(last - F.lit(per - 1), F.lit(0)), last)
    x = d.withColumn("_j", F.explode(js))
    start = F.col("_min") + F.col("_j") * F.lit(s_us)
    x = x.filter((F.col("ts_us") >= start) & (F.col("ts_us") < start + F.lit(w_us))
                 & (start + F.lit(w_us) <= F.col("_max") + F.lit(US_PER_DAY)))
    entity = F.concat_ws(":", F.col(K).cast("string"), "_j")  # the index holds no colon, so no two pairs share it
    keep = x.groupBy(K, "_j").agg(F.count("*").alias("num_transactions"), F.sum("amount").alias("total_volume"),
                                  F.min("_min").alias("_mn")).filter(F.col("num_transactions") >= 3)
    ent = stored(x.select("ts_us", "amount", "counterparty", "transaction_type", "transaction_id",
                          F.col(K).cast("string").alias("_owner"), entity.alias(K)), "timeline")
    beh = S.all_signals(ent, min_rows=3, window_days=signal_window_days)
    valid = F.col("counterparty").isNotNull() & ~F.col("counterparty").isin(*INVALID_COUNTERPARTIES)
    star = ent.groupBy(K).agg(
        F.count_distinct(F.when(valid, F.col("counterparty"))).alias("out_degree"),
        F.max(valid & (F.col("counterparty") == F.col("_owner"))).alias("has_circular_flow"))
    vel = GF.flow_velocity(ent)
    net = star.join(vel, K).select(
        K, "has_circular_flow",
        F.when(F.col("out_degree") > 0, 1).otherwise(0).alias("layer_depth"),
        F.col("out_degree").cast("double").alias("funnel_ratio"),
        (F.col("out_degree") >= 4).alias("is_funnel_hub"),
        "flow_velocity", "rapid_passthrough_count")
    b = bsi_dimensions(beh.join(net, K))
    kk = keep.withColumn(K + "_w", entity)
    j = kk.join(b.withColumnRenamed(K, K + "_w"), K + "_w")
    ws = F.col("_mn") + F.col("_j") * F.lit(s_us)
    return j.select(
        K, F.col("_j").alias("window_index"),
        ws.alias("window_start_us"), (ws + F.lit(w_us)).alias("window_end_us"),
        (ws + F.lit((window_days // 2) * US_PER_DAY)).alias("window_midpoint_us"),
        "num_transactions", "total_volume", "bsi_score", "drift_level", *DIMENSIONS)

"""D01–D05 dashboard aggregates and E01–E14 detection-quality metrics.

Ranking metrics (AUC, AP, best threshold) are computed from per-distinct-
score class counts (a partial aggregate) and exact global running sums
(``functions.cumulative``), so no step holds all scores in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.exprs import attach_scalars

from driftwatch.functions import dims
from driftwatch.functions.cumulative import global_running_sum

K = "customer_id"
LEVELS = ["critical", "high", "moderate", "stable"]
MONITOR_LEVELS = ["immediate", "intensive", "enhanced", "standard"]


# ------------------------------------------------------------------ dashboard
def kpi_row(alerts: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Alerts, high severity, open, reports written, total amount."""
    a = alerts.agg(F.count("*").alias("total_alerts"),
                   F.count(F.when(F.col("severity") == "high", 1)).alias("high_severity"),
                   F.count(F.when(F.col("status") == "open", 1)).alias("pending_review"),
                   F.sum("total_amount").alias("suspicious_volume"))
    r = (reports.agg(F.count("*").alias("reports_generated")) if reports is not None
         else a.sparkSession.range(1).select(F.lit(0).cast("long").alias("reports_generated")))
    return a.crossJoin(r)


def counts_by(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (typology of alerts, drift level of BSI…)."""
    return df.groupBy(col).agg(F.count("*").alias("count"))


def histogram(df: DataFrame, col: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Fixed-width histogram on [lo, hi] with every bin present (the
    top edge goes to the last bin)."""
    width = (hi - lo) / bins
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(col) - lo) / width))).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left").fillna({"count": 0})
            .withColumn("bin_start", F.lit(lo) + F.col("bin") * F.lit(width))
            .withColumn("bin_end", F.lit(lo) + (F.col("bin") + 1) * F.lit(width)))


def top_alerts(alerts: DataFrame, customers: DataFrame, bsi: DataFrame, score_col: str = "risk_score",
               n: int = 20) -> DataFrame:
    """The ``n`` highest-scored alerts with name, BSI, drift and percent
    (a top-k report: the limit is the feature)."""
    a = alerts.join(customers.select(K, "name"), K, "left").join(bsi.select(K, "bsi_score", "drift_level"), K, "left")
    return (a.orderBy(F.col(score_col).desc_nulls_last(), F.col("alert_id")).limit(n)
            .withColumn("risk_pct", F.round(F.col(score_col) * 100, 1)))


def signal_strengths(features: DataFrame) -> DataFrame:
    """Seven scaled signals per customer, long form."""
    g = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d))
    pairs = [("Entropy Drift", g("amount_entropy_drift")),
             ("Burstiness", F.abs(g("burstiness_index"))),
             ("CP Expansion", g("counterparty_expansion_rate") / 10),
             ("Benford Dev", g("benford_deviation") / 2),
             ("Structuring", g("structuring_score")),
             ("Flow Velocity", g("flow_velocity") * 10),
             ("Funnel Ratio", (g("funnel_ratio", 1.0) - 1) / 10)]
    arr = F.array(*[F.struct(F.lit(n).alias("signal"), v.cast("double").alias("value")) for n, v in pairs])
    return features.select(K, F.inline(arr))


# ----------------------------------------------------------------- evaluation
def attach_truth(scores: DataFrame, truth: DataFrame, label_col: str = "is_suspicious") -> DataFrame:
    """Left join the labels; missing -> 0."""
    t = truth.select(K, F.col(label_col).cast("int").alias("is_fraud"))
    return scores.join(t, K, "left").fillna({"is_fraud": 0})


def class_separation(df: DataFrame, col: str = "bsi_score") -> DataFrame:
    """Mean / median / std / min / max per class, legit − fraud gap and
    its direction.  The exact median keeps a value→count map per class;
    BSI scores have two decimals in [0, 100], so it is bounded (10,001)."""
    s = df.groupBy("is_fraud").agg(F.count("*").alias("n"), F.avg(col).alias("mean"),
                                   F.median(col).alias("median"), F.stddev_samp(col).alias("std"),
                                   F.min(col).alias("min"), F.max(col).alias("max"))
    gap = s.agg((F.max(F.when(F.col("is_fraud") == 0, F.col("mean")))
                 - F.max(F.when(F.col("is_fraud") == 1, F.col("mean")))).alias("separation"))
    return s.crossJoin(gap).withColumn("direction_ok", F.col("separation") > 0)


def level_by_class(df: DataFrame, level_col: str = "drift_level", levels=LEVELS) -> DataFrame:
    """Rows per (level, class) with percent of the class; all levels kept."""
    lv = df.sparkSession.createDataFrame([(x,) for x in levels], f"{level_col} string")
    cls = df.groupBy("is_fraud").agg(F.count("*").alias("_cls_n"))
    c = df.groupBy(level_col, "is_fraud").agg(F.count("*").alias("count"))
    grid = lv.crossJoin(F.broadcast(cls))  # levels × 2 classes
    return (grid.join(c, [level_col, "is_fraud"], "left").fillna({"count": 0})
            .withColumn("pct", F.col("count") / F.greatest(F.col("_cls_n"), F.lit(1)) * 100).drop("_cls_n"))


def threshold_rates(df: DataFrame, col: str = "bsi_score", thresholds=dims.EVAL_THRESHOLDS) -> DataFrame:
    """TP / FP / TPR / FPR for score ≤ threshold, one pass."""
    aggs = [F.count(F.when(F.col("is_fraud") == 1, 1)).alias("_p"), F.count(F.when(F.col("is_fraud") == 0, 1)).alias("_n")]
    for t in thresholds:
        aggs += [F.count(F.when((F.col("is_fraud") == 1) & (F.col(col) <= t), 1)).alias(f"tp_{t}"),
                 F.count(F.when((F.col("is_fraud") == 0) & (F.col(col) <= t), 1)).alias(f"fp_{t}")]
    a = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp_{t}").alias("tp"), F.col(f"fp_{t}").alias("fp"))
                     for t in thresholds])
    out = a.select("_p", "_n", F.inline(rows))
    return out.select("threshold", F.col("tp").cast("long"), F.col("fp").cast("long"),
                      (F.col("tp") / F.greatest("_p", F.lit(1)) * 100).alias("tpr"),
                      (F.col("fp") / F.greatest("_n", F.lit(1)) * 100).alias("fpr"))


def _score_counts(df: DataFrame, score: F.Column) -> DataFrame:
    return (df.select(score.alias("s"), "is_fraud").filter(F.col("s").isNotNull())
            .groupBy("s").agg(F.count(F.when(F.col("is_fraud") == 1, 1)).alias("pos"),
                              F.count(F.when(F.col("is_fraud") == 0, 1)).alias("neg")))


def roc_frame(df: DataFrame, score: F.Column) -> DataFrame:
    """Per distinct score (descending): cumulative TP/FP at ``score >= s``,
    class totals.  Distributed running sums."""
    c = _score_counts(df, score)
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = global_running_sum(c, [F.col("s").desc()], ["pos", "neg"])
    return attach_scalars(r, tot)


def auc_roc(df: DataFrame, score: F.Column) -> DataFrame:
    """Exact AUC with ties = Σ_s pos(s)·(neg(<s) + ½·neg(=s)) / (P·N)."""
    r = roc_frame(df, score)
    below = F.col("N") - F.col("cum_neg")  # negatives with a strictly lower score
    return r.agg((F.sum(F.col("pos") * (below + F.col("neg") * 0.5)) / (F.first("P") * F.first("N"))).alias("auc_roc"),
                 F.first("P").alias("positives"), F.first("N").alias("negatives"))


def average_precision(df: DataFrame, score: F.Column) -> DataFrame:
    """AP = Σ over distinct scores (desc) of recall step × precision."""
    r = roc_frame(df, score)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return r.agg(F.sum(F.col("pos") / F.col("P") * prec).alias("average_precision"))


def best_threshold(df: DataFrame, score: F.Column) -> DataFrame:
    """The score threshold maximising TPR − FPR (ties: higher threshold)."""
    r = roc_frame(df, score)
    j = (F.col("cum_pos") / F.col("P")) - (F.col("cum_neg") / F.col("N"))
    return r.agg(F.max_by(F.struct("s", (F.col("cum_pos") / F.col("P")).alias("tpr"),
                                   (F.col("cum_neg") / F.col("N")).alias("fpr")),
                          F.struct(j, F.col("s"))).alias("b")) \
        .select(F.col("b.s").alias("threshold"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"))


def escalation_coverage(monitor: DataFrame) -> DataFrame:
    """Fraud accounts at immediate, at immediate+intensive, and percent."""
    f = monitor.filter(F.col("is_fraud") == 1)
    return f.agg(F.count("*").alias("fraud_accounts"),
                 F.count(F.when(F.col("monitoring_level") == "immediate", 1)).alias("immediate"),
                 F.count(F.when(F.col("monitoring_level").isin("immediate", "intensive"), 1)).alias("escalated")) \
        .withColumn("escalated_pct", F.col("escalated") / F.greatest("fraud_accounts", F.lit(1)) * 100)


def signal_separation(df: DataFrame, signal_cols: list[str]) -> DataFrame:
    """Class means per signal and the direction, long form."""
    arr = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("v")) for c in signal_cols])
    long = df.select("is_fraud", F.inline(arr))
    return (long.groupBy("signal").agg(F.avg(F.when(F.col("is_fraud") == 1, F.col("v"))).alias("fraud_mean"),
                                       F.avg(F.when(F.col("is_fraud") == 0, F.col("v"))).alias("legit_mean"))
            .withColumn("direction", F.when(F.col("fraud_mean") > F.col("legit_mean"), "up").otherwise("down")))


def bsi_vs_probability(bsi: DataFrame, txns: DataFrame, prob_col: str = "fraud_probability") -> DataFrame:
    """Pearson r of (100 − BSI) and each account's mean native probability."""
    p = txns.filter(F.col(prob_col).isNotNull()).groupBy(K).agg(F.avg(prob_col).alias("avg_fraud_prob"))
    j = bsi.join(p, K)
    return j.agg(F.corr(100 - F.col("bsi_score"), F.col("avg_fraud_prob")).alias("pearson_r"),
                 F.count("*").alias("accounts"))


def typology_catch(bsi: DataFrame, customers: DataFrame, cutoff: float = 50.0) -> DataFrame:
    """Per typology of the fraud accounts: mean BSI and share at ≤ cutoff."""
    j = bsi.join(customers.filter(F.col("typology").isNotNull()).select(K, "typology"), K)
    return j.groupBy("typology").agg(F.count("*").alias("accounts"), F.avg("bsi_score").alias("mean_bsi"),
                                     (F.count(F.when(F.col("bsi_score") <= cutoff, 1)) / F.count("*") * 100).alias("caught_pct"))


def run_summary(rows: list[DataFrame]) -> DataFrame:
    """One summary row per dataset (each input is a one-row frame)."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def high_risk_counts(scored: DataFrame, thr: float = dims.HIGH_RISK_THRESHOLD) -> DataFrame:
    """Accounts scored ≥ 0.7 and fraud among them."""
    hr = F.col("risk_score") >= thr
    return scored.agg(F.count(F.when(hr, 1)).alias("high_risk"),
                      F.count(F.when(hr & (F.col("is_fraud") == 1), 1)).alias("fraud_in_high_risk"),
                      F.sum("is_fraud").cast("long").alias("fraud_total"))


def classification_report(scored: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    c = scored.agg(*[F.count(F.when((F.col("is_fraud") == a) & (F.col(pred_col) == p), 1)).alias(f"c{a}{p}")
                     for a in (0, 1) for p in (0, 1)])
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        rows.append(F.struct(F.lit(k).alias("label"), prec.alias("precision"), rec.alias("recall"),
                             F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
                             (tp + fn).alias("support")))
    return c.select(F.inline(F.array(*rows)))

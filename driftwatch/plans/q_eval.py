"""Registered dashboard (D01–D05) and evaluation (E01–E14) queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.operators import evaluate as EV
from driftwatch.operators import stability as ST
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.q_alerts import ALERTS_CTE, _alerts
from driftwatch.plans.q_model import BSI_CTE
from driftwatch.plans.q_model import behavioural_stage as behavioural
from driftwatch.plans.q_model import bsi_stage
from driftwatch.plans.q_model import network_stage as network
from driftwatch.plans.stages import view as V
from driftwatch.sources import tables as TB

SIGNALS_E08 = ["amount_entropy_drift", "timing_entropy_drift", "counterparty_entropy_drift",
               "burstiness_index", "counterparty_expansion_rate", "structuring_score",
               "benford_deviation", "funnel_ratio", "layer_depth", "cycle_total_amount"]


def _bsi(spark, sf):
    return bsi_stage(spark, sf)


def _scored(spark, sf):
    return EV.attach_truth(_bsi(spark, sf), V(spark, sf, "customers_v"))


def _risk(df):
    return 100 - F.col("bsi_score")


def q_d01_kpi_row(spark, sf):
    prep(spark)
    return rounded(EV.kpi_row(_alerts(spark, sf)))


def q_d02_alerts_by_typology(spark, sf):
    prep(spark)
    return EV.counts_by(_alerts(spark, sf), "alert_type")


def q_d03_bsi_histogram(spark, sf):
    prep(spark)
    return rounded(EV.histogram(_bsi(spark, sf), "bsi_score", 30, 0.0, 100.0))


def q_d04_top_alerts(spark, sf):
    prep(spark)
    b = _bsi(spark, sf)
    a = _alerts(spark, sf).join(b.select("customer_id", ((100 - F.col("bsi_score")) / 100).alias("risk_score")),
                                "customer_id", "left")
    t = EV.top_alerts(a, V(spark, sf, "customers_v"), b)
    return rounded(t.select("alert_id", "name", "alert_type", "total_amount", "risk_pct", "bsi_score",
                            "drift_level", "status"))


def q_d05_signal_strengths(spark, sf):
    prep(spark)
    f = behavioural(spark, sf).join(network(spark, sf), "customer_id")
    return rounded(EV.signal_strengths(f))


def q_e01_class_separation(spark, sf):
    prep(spark)
    return rounded(EV.class_separation(_scored(spark, sf)))


def q_e02_drift_by_class(spark, sf):
    prep(spark)
    return rounded(EV.level_by_class(_scored(spark, sf)))


def q_e03_threshold_rates(spark, sf):
    prep(spark)
    return rounded(EV.threshold_rates(_scored(spark, sf)))


def q_e04_auc_roc(spark, sf):
    prep(spark)
    return rounded(EV.auc_roc(_scored(spark, sf), 100 - F.col("bsi_score")))


def q_e05_average_precision(spark, sf):
    prep(spark)
    return rounded(EV.average_precision(_scored(spark, sf), 100 - F.col("bsi_score")))


def q_e06_best_threshold(spark, sf):
    prep(spark)
    b = EV.best_threshold(_scored(spark, sf), 100 - F.col("bsi_score"))
    return rounded(b.select((100 - F.col("threshold")).alias("bsi_threshold"), "tpr", "fpr"))


def q_e07_escalation_coverage(spark, sf):
    prep(spark)
    m = ST.monitoring_state(_bsi(spark, sf), "2025-12-31 00:00:00")
    return rounded(EV.escalation_coverage(EV.attach_truth(m, V(spark, sf, "customers_v"))))


def q_e08_signal_separation(spark, sf):
    prep(spark)
    f = behavioural(spark, sf).join(network(spark, sf), "customer_id")
    return rounded(EV.signal_separation(EV.attach_truth(f, V(spark, sf, "customers_v")), SIGNALS_E08))


def q_e09_bsi_vs_probability(spark, sf):
    prep(spark)
    t = V(spark, sf, "tx_orders").withColumn("fraud_probability", (F.col("src_partkey") % 100) / 100.0)
    return rounded(EV.bsi_vs_probability(_bsi(spark, sf), t))


def q_e10_typology_catch(spark, sf):
    prep(spark)
    return rounded(EV.typology_catch(_bsi(spark, sf), V(spark, sf, "customers_v")))


def q_e14_attach_truth(spark, sf):
    prep(spark)
    return _scored(spark, sf).select("customer_id", "bsi_score", "is_fraud")


QUERIES = {
    "d01_kpi_row": q_d01_kpi_row,
    "d02_alerts_by_typology": q_d02_alerts_by_typology,
    "d03_bsi_histogram": q_d03_bsi_histogram,
    "d04_top_alerts": q_d04_top_alerts,
    "d05_signal_strengths": q_d05_signal_strengths,
    "e01_class_separation": q_e01_class_separation,
    "e02_drift_by_class": q_e02_drift_by_class,
    "e03_threshold_rates": q_e03_threshold_rates,
    "e04_auc_roc": q_e04_auc_roc,
    "e05_average_precision": q_e05_average_precision,
    "e06_best_threshold": q_e06_best_threshold,
    "e07_escalation_coverage": q_e07_escalation_coverage,
    "e08_signal_separation": q_e08_signal_separation,
    "e09_bsi_vs_probability": q_e09_bsi_vs_probability,
    "e10_typology_catch": q_e10_typology_catch,
    "e14_attach_truth": q_e14_attach_truth,
}

# ----------------------------------------------------------------- DuckDB side
SCORED = """,
scored AS (SELECT lv.*, CAST(coalesce(c.is_suspicious, false) AS INTEGER) AS is_fraud
           FROM lv LEFT JOIN customers_v c USING (customer_id)),
sc AS (SELECT 100 - bsi_score AS s, count(*) FILTER (WHERE is_fraud = 1) AS pos,
              count(*) FILTER (WHERE is_fraud = 0) AS neg FROM scored GROUP BY 1),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc),
roc AS (SELECT sc.*, sum(pos) OVER (ORDER BY s DESC) AS cum_pos, sum(neg) OVER (ORDER BY s DESC) AS cum_neg, P, N
        FROM sc CROSS JOIN tot)"""

SIG_SQL = ", ".join(f"('{c}', CAST({c} AS DOUBLE))" for c in SIGNALS_E08)

ORACLES = {
    "d01_kpi_row": with_views("," + ALERTS_CTE + """
SELECT CAST(count(*) AS BIGINT) AS total_alerts, CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS high_severity,
       CAST(count(*) FILTER (WHERE status = 'open') AS BIGINT) AS pending_review,
       round(sum(total_amount), 6) AS suspicious_volume, CAST(0 AS BIGINT) AS reports_generated FROM alerts
"""),
    "d02_alerts_by_typology": with_views("," + ALERTS_CTE + """
SELECT alert_type, CAST(count(*) AS BIGINT) AS "count" FROM alerts GROUP BY 1
"""),
    "d03_bsi_histogram": with_views(BSI_CTE + """,
h AS (SELECT CAST(least(29, greatest(0, floor((bsi_score - 0.0) / (100.0 / 30)))) AS INTEGER) AS bin, count(*) AS c FROM lv GROUP BY 1),
g AS (SELECT CAST(unnest(range(0, 30)) AS INTEGER) AS bin)
SELECT g.bin, CAST(coalesce(h.c, 0) AS BIGINT) AS "count", round(0.0 + g.bin * (100.0 / 30), 6) AS bin_start,
       round(0.0 + (g.bin + 1) * (100.0 / 30), 6) AS bin_end
FROM g LEFT JOIN h USING (bin)
"""),
    "d04_top_alerts": with_views(BSI_CTE + ", " + ALERTS_CTE + """,
t AS (SELECT a.*, c.name, lv.bsi_score, lv.drift_level, (100 - lv.bsi_score) / 100 AS risk_score
      FROM alerts a LEFT JOIN customers_v c USING (customer_id) LEFT JOIN lv USING (customer_id)
      ORDER BY risk_score DESC NULLS LAST, alert_id LIMIT 20)
SELECT alert_id, name, alert_type, round(total_amount, 6) AS total_amount, round(round(risk_score * 100, 1), 6) AS risk_pct,
       round(bsi_score, 6) AS bsi_score, drift_level, status FROM t
"""),
    "d05_signal_strengths": with_views(BSI_CTE + """,
f AS (SELECT * FROM sg_out JOIN net USING (customer_id))
SELECT customer_id, signal, round(value, 6) AS value FROM (
  SELECT customer_id, 'Entropy Drift' AS signal, CAST(amount_entropy_drift AS DOUBLE) AS value FROM f
  UNION ALL SELECT customer_id, 'Burstiness', abs(burstiness_index) FROM f
  UNION ALL SELECT customer_id, 'CP Expansion', counterparty_expansion_rate / 10 FROM f
  UNION ALL SELECT customer_id, 'Benford Dev', benford_deviation / 2 FROM f
  UNION ALL SELECT customer_id, 'Structuring', structuring_score FROM f
  UNION ALL SELECT customer_id, 'Flow Velocity', flow_velocity * 10 FROM f
  UNION ALL SELECT customer_id, 'Funnel Ratio', (funnel_ratio - 1) / 10 FROM f)
"""),
    "e01_class_separation": with_views(BSI_CTE + SCORED + """,
s AS (SELECT is_fraud, count(*) AS n, avg(bsi_score) AS mean, quantile_cont(bsi_score, 0.5) AS median,
             stddev_samp(bsi_score) AS std, min(bsi_score) AS min, max(bsi_score) AS max FROM scored GROUP BY 1),
g AS (SELECT max(mean) FILTER (WHERE is_fraud = 0) - max(mean) FILTER (WHERE is_fraud = 1) AS separation FROM s)
SELECT is_fraud, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
       round(min, 6) AS min, round(max, 6) AS max, round(separation, 6) AS separation, separation > 0 AS direction_ok
FROM s CROSS JOIN g
"""),
    "e02_drift_by_class": with_views(BSI_CTE + SCORED + """,
lvls AS (SELECT * FROM (VALUES ('critical'), ('high'), ('moderate'), ('stable')) v(drift_level)),
cls AS (SELECT is_fraud, count(*) AS cn FROM scored GROUP BY 1),
c AS (SELECT drift_level, is_fraud, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT l.drift_level, k.is_fraud, CAST(coalesce(c.n, 0) AS BIGINT) AS "count",
       round(coalesce(c.n, 0) / greatest(k.cn, 1) * 100, 6) AS pct
FROM lvls l CROSS JOIN cls k LEFT JOIN c ON c.drift_level = l.drift_level AND c.is_fraud = k.is_fraud
"""),
    "e03_threshold_rates": with_views(BSI_CTE + SCORED + """,
th AS (SELECT * FROM (VALUES (25), (35), (50), (60), (75)) v(threshold)),
tot2 AS (SELECT count(*) FILTER (WHERE is_fraud = 1) AS p, count(*) FILTER (WHERE is_fraud = 0) AS n FROM scored)
SELECT th.threshold, CAST(count(*) FILTER (WHERE s.is_fraud = 1 AND s.bsi_score <= th.threshold) AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE s.is_fraud = 0 AND s.bsi_score <= th.threshold) AS BIGINT) AS fp,
       round(count(*) FILTER (WHERE s.is_fraud = 1 AND s.bsi_score <= th.threshold) / greatest(any_value(t.p), 1) * 100, 6) AS tpr,
       round(count(*) FILTER (WHERE s.is_fraud = 0 AND s.bsi_score <= th.threshold) / greatest(any_value(t.n), 1) * 100, 6) AS fpr
FROM th CROSS JOIN scored s CROSS JOIN tot2 t GROUP BY th.threshold
"""),
    "e04_auc_roc": with_views(BSI_CTE + SCORED + """
SELECT round(sum(pos * ((N - cum_neg) + neg * 0.5)) / (any_value(P) * any_value(N)), 6) AS auc_roc,
       CAST(any_value(P) AS BIGINT) AS positives, CAST(any_value(N) AS BIGINT) AS negatives FROM roc
"""),
    "e05_average_precision": with_views(BSI_CTE + SCORED + """
SELECT round(sum(pos / P * (cum_pos / (cum_pos + cum_neg))), 6) AS average_precision FROM roc
"""),
    "e06_best_threshold": with_views(BSI_CTE + SCORED + """
SELECT round(100 - arg_max(s, (cum_pos / P - cum_neg / N, s)), 6) AS bsi_threshold,
       round(arg_max(cum_pos / P, (cum_pos / P - cum_neg / N, s)), 6) AS tpr,
       round(arg_max(cum_neg / N, (cum_pos / P - cum_neg / N, s)), 6) AS fpr FROM roc
"""),
    "e07_escalation_coverage": with_views(BSI_CTE + SCORED + """
SELECT CAST(count(*) AS BIGINT) AS fraud_accounts,
       CAST(count(*) FILTER (WHERE monitoring_level = 'immediate') AS BIGINT) AS immediate,
       CAST(count(*) FILTER (WHERE monitoring_level IN ('immediate', 'intensive')) AS BIGINT) AS escalated,
       round(count(*) FILTER (WHERE monitoring_level IN ('immediate', 'intensive')) / greatest(count(*), 1) * 100, 6) AS escalated_pct
FROM scored WHERE is_fraud = 1
"""),
    "e08_signal_separation": with_views(BSI_CTE + f""",
f AS (SELECT m.*, CAST(coalesce(c.is_suspicious, false) AS INTEGER) AS is_fraud
      FROM (SELECT * FROM sg_out JOIN net USING (customer_id)) m LEFT JOIN customers_v c USING (customer_id)),
l AS (SELECT is_fraud, unnest([{", ".join(f"{{'signal': '{c}', 'v': CAST({c} AS DOUBLE)}}" for c in SIGNALS_E08)}]) AS x FROM f)
SELECT x.signal AS signal, round(avg(x.v) FILTER (WHERE is_fraud = 1), 6) AS fraud_mean,
       round(avg(x.v) FILTER (WHERE is_fraud = 0), 6) AS legit_mean,
       CASE WHEN avg(x.v) FILTER (WHERE is_fraud = 1) > avg(x.v) FILTER (WHERE is_fraud = 0) THEN 'up' ELSE 'down' END AS direction
FROM l GROUP BY 1
"""),
    "e09_bsi_vs_probability": with_views(BSI_CTE + """,
p AS (SELECT customer_id, avg((src_partkey % 100) / 100.0) AS avg_fraud_prob FROM tx_orders GROUP BY 1)
SELECT round(corr(100 - bsi_score, avg_fraud_prob), 6) AS pearson_r, CAST(count(*) AS BIGINT) AS accounts
FROM lv JOIN p USING (customer_id)
"""),
    "e10_typology_catch": with_views(BSI_CTE + """
SELECT c.typology, CAST(count(*) AS BIGINT) AS accounts, round(avg(bsi_score), 6) AS mean_bsi,
       round(count(*) FILTER (WHERE bsi_score <= 50) / count(*) * 100, 6) AS caught_pct
FROM lv JOIN customers_v c USING (customer_id) WHERE c.typology IS NOT NULL GROUP BY 1
"""),
    "e14_attach_truth": with_views(BSI_CTE + SCORED + "\nSELECT customer_id, bsi_score, is_fraud FROM scored"),
}


def q_e11_run_summary(spark, sf):
    """One summary row per dataset (orders view and events view)."""
    prep(spark)
    rows = []
    for name, tx, cust in (("tx_orders", V(spark, sf, "tx_orders"), V(spark, sf, "customers_v")),):
        s = EV.attach_truth(bsi_stage(spark, sf), cust)
        auc = EV.auc_roc(s, 100 - F.col("bsi_score"))
        sep = s.agg((F.avg(F.when(F.col("is_fraud") == 0, F.col("bsi_score")))
                     - F.avg(F.when(F.col("is_fraud") == 1, F.col("bsi_score")))).alias("separation"),
                    F.count("*").alias("accounts"), F.sum("is_fraud").cast("long").alias("fraud_accounts"))
        rows.append(sep.crossJoin(auc.select("auc_roc")).select(F.lit(name).alias("dataset"), "*")
                    .crossJoin(tx.agg(F.count("*").alias("transactions"))))
    ev = V(spark, sf, "tx_events")
    rows.append(ev.agg(F.countDistinct("customer_id").alias("accounts"), F.count("*").alias("transactions"))
                .select(F.lit("tx_events").alias("dataset"), "*"))
    return rounded(EV.run_summary(rows))


QUERIES["e11_run_summary"] = q_e11_run_summary

"""Registered classifier queries.

The model is trained once per Spark application and data folder (the
reference trains once per pipeline run); queries read it from that stage.
The split and the medians have DuckDB oracles; what follows the trained model is checked by
property tests (AUC floor, score range, counterfactual consistency) and rows-only by the driver.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.operators import evaluate as EV
from driftwatch.operators import features as FT
from driftwatch.operators import model as M
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.q_alerts import _alerts
from driftwatch.plans.q_model import behavioural_stage, bsi_stage, network_stage
from driftwatch.plans.stages import stage
from driftwatch.plans.stages import view as V

_MODELS: dict = {}


def matrix(spark, sf):
    """F04 + F05 stage: merged, sanitised feature matrix."""
    return stage(spark, sf, "feature_matrix", lambda: FT.sanitize(FT.merge_features(
        FT.traditional_features(V(spark, sf, "customers_v"), V(spark, sf, "tx_orders")),
        behavioural_stage(spark, sf), network_stage(spark, sf), bsi_stage(spark, sf))))


def trained(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = M.train_classifier(matrix(spark, sf))
    return _MODELS[key]


def scored(spark, sf):
    model, cols, data = trained(spark, sf)
    return stage(spark, sf, "scored", lambda: M.score(model, data))


def q_f06_split(spark, sf):
    prep(spark)
    _, _, data = trained(spark, sf)
    return data.groupBy("is_suspicious", "is_test").agg(F.count("*").alias("rows"))


def q_f06_split_rows(spark, sf):
    """F06 on every customer."""
    prep(spark)
    c = V(spark, sf, "customers_v").select("customer_id", "is_suspicious")
    return FT.stratified_split(c)


def q_f14_population_medians(spark, sf):
    """The scenario values of F14: exact medians of account and transfer figures per customer."""
    prep(spark)
    t = V(spark, sf, "tx_orders").groupBy("customer_id").agg(
        F.count("*").alias("txn_count"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        F.min("ts_us").cast("double").alias("first_us"), F.max("ts_us").cast("double").alias("last_us"))
    return M.population_medians(t, ["txn_count", "min_amount", "max_amount", "first_us", "last_us"])


def q_f07_train_classifier(spark, sf):
    prep(spark)
    model, cols, data = trained(spark, sf)
    gbt = model.stages[-1]
    return spark.createDataFrame([(len(cols), gbt.getNumTrees, gbt.getMaxDepth())],
                                 "num_features int, num_trees int, max_depth int")


def q_f08_risk_scores(spark, sf):
    prep(spark)
    return rounded(scored(spark, sf).select("customer_id", "is_suspicious", "is_test", "risk_score", "prediction"))


def q_f09_enriched_alerts(spark, sf):
    prep(spark)
    return rounded(M.enrich_alerts(_alerts(spark, sf), scored(spark, sf)).drop("alert_date"))


def q_f10_feature_importance(spark, sf):
    prep(spark)
    model, cols, _ = trained(spark, sf)
    return rounded(M.feature_importance(model, cols))


def q_e12_high_risk_counts(spark, sf):
    prep(spark)
    return EV.high_risk_counts(scored(spark, sf).withColumn("is_fraud", F.col("is_suspicious")))


def q_e13_classification_report(spark, sf):
    prep(spark)
    s = scored(spark, sf).filter(F.col("is_test")).withColumn("is_fraud", F.col("is_suspicious"))
    return rounded(EV.classification_report(s))


def q_e04_auc_classifier(spark, sf):
    prep(spark)
    s = scored(spark, sf).withColumn("is_fraud", F.col("is_suspicious"))
    return rounded(EV.auc_roc(s, F.col("risk_score")))


def _cf(spark, sf):
    model, cols, _ = trained(spark, sf)
    return stage(spark, sf, "counterfactuals", lambda: M.counterfactuals(model, matrix(spark, sf), cols))


def q_f14_counterfactuals(spark, sf):
    prep(spark)
    return rounded(_cf(spark, sf))


def q_f15_counterfactual_summary(spark, sf):
    prep(spark)
    return rounded(M.counterfactual_summary(_cf(spark, sf)))


def q_f17_counterfactual_text(spark, sf):
    prep(spark)
    cf = _cf(spark, sf)
    return M.counterfactual_text(cf, M.counterfactual_summary(cf))


QUERIES = {
    "f06_split": q_f06_split,
    "f06_split_rows": q_f06_split_rows,
    "f14_population_medians": q_f14_population_medians,
    "f07_train_classifier": q_f07_train_classifier,
    "f08_risk_scores": q_f08_risk_scores,
    "f09_enriched_alerts": q_f09_enriched_alerts,
    "f10_feature_importance": q_f10_feature_importance,
    "e12_high_risk_counts": q_e12_high_risk_counts,
    "e13_classification_report": q_e13_classification_report,
    "e04_auc_classifier": q_e04_auc_classifier,
    "f14_counterfactuals": q_f14_counterfactuals,
    "f15_counterfactual_summary": q_f15_counterfactual_summary,
    "f17_counterfactual_text": q_f17_counterfactual_text,
}

_SPLIT = """
SELECT customer_id, is_suspicious,
  row_number() OVER (PARTITION BY is_suspicious ORDER BY h, customer_id)
    <= floor(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY is_suspicious)) AS is_test
FROM (SELECT customer_id, is_suspicious, CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '|42'), 1, 15) AS BIGINT) AS h
      FROM customers_v)
"""
ORACLES: dict = {
    "f06_split_rows": with_views(_SPLIT),
    "f06_split": with_views(f"""
SELECT CAST(is_suspicious AS INTEGER) AS is_suspicious, is_test, count(*) AS "rows" FROM ({_SPLIT.replace(
    "FROM customers_v", "FROM customers_v WHERE customer_id IN (SELECT customer_id FROM tx_orders)")}) GROUP BY 1, 2
"""),
    "f14_population_medians": with_views("""
SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) AS txn_count, quantile_cont(mn, 0.5) AS min_amount, quantile_cont(mx, 0.5) AS max_amount,
  quantile_cont(f, 0.5) AS first_us, quantile_cont(l, 0.5) AS last_us
FROM (SELECT customer_id, count(*) AS n, min(amount) AS mn, max(amount) AS mx, CAST(min(ts_us) AS DOUBLE) AS f, CAST(max(ts_us) AS DOUBLE) AS l
      FROM tx_orders GROUP BY customer_id)
"""),
}


# ------------------------------------------------------------ F11–F13, F16
from driftwatch.operators import attribution as AT  # noqa: E402


def _attr(spark, sf):
    model, cols, _ = trained(spark, sf)
    return stage(spark, sf, "attributions", lambda: AT.attributions(model, matrix(spark, sf), cols))


def q_f11_attributions(spark, sf):
    prep(spark)
    return rounded(AT.top_drivers(_attr(spark, sf), 10))


def q_f11_additivity(spark, sf):
    """Property: bias + Σ contributions equals the model margin per row."""
    prep(spark)
    model, cols, _ = trained(spark, sf)
    a = AT.margins(_attr(spark, sf))
    raw = model.transform(matrix(spark, sf)).select(
        "customer_id", __import__("pyspark.ml.functions", fromlist=["vector_to_array"])
        .vector_to_array("rawPrediction")[1].alias("model_margin"))
    return rounded(a.join(raw, "customer_id").withColumn(
        "abs_error", F.abs(F.col("attributed_margin") - F.col("model_margin"))))


def q_f12_global_importance(spark, sf):
    prep(spark)
    return rounded(AT.global_importance(_attr(spark, sf)))


def q_f13_dimension_weights(spark, sf):
    prep(spark)
    return rounded(AT.dimension_weights(AT.global_importance(_attr(spark, sf))))


def q_f16_finding_texts(spark, sf):
    prep(spark)
    return AT.finding_texts(AT.top_drivers(_attr(spark, sf), 10), V(spark, sf, "customers_v"))


QUERIES.update({
    "f11_attributions": q_f11_attributions,
    "f11_additivity": q_f11_additivity,
    "f12_global_importance": q_f12_global_importance,
    "f13_dimension_weights": q_f13_dimension_weights,
    "f16_finding_texts": q_f16_finding_texts,
})

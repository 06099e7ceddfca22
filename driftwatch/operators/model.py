"""Boosted-tree classifier, scores, importances and
counterfactual rescoring with Spark ML.

Training uses ``GBTClassifier`` (100 trees, depth 6, step 0.1, seed 42, as
the reference's booster).  Counterfactuals are one ``transform`` over the
customer rows × 8 dimension scenarios (an 8× explode), with the population
medians computed exactly and distributed (``functions.quantile``).
"""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.exprs import attach_scalars
from pyspark.sql import types as T

from driftwatch.functions import dims
from driftwatch.functions.quantile import exact_quantiles
from driftwatch.operators.features import stratified_split

K = "customer_id"
EXCLUDE = {K, "is_suspicious", "typology", "risk_score", "drift_level", "num_unique_counterparties", "is_test",
           "prediction", "is_fraud"}

# FIXED VALUES: counterfactual dimensions (reference order)
CF_DIMENSIONS = [
    ("Entropy Drift", ["amount_entropy_drift", "timing_entropy_drift", "counterparty_entropy_drift"]),
    ("Temporal Burst", ["burstiness_index", "burst_events", "max_daily_count"]),
    ("Counterparty Expansion", ["counterparty_expansion_rate", "counterparty_novelty_slope",
                                "total_unique_counterparties"]),
    ("Amount Anomaly", ["benford_deviation", "structuring_score", "round_amount_ratio"]),
    ("Network Topology", ["funnel_ratio", "layer_depth", "flow_velocity"]),
    ("Transaction Volume", ["total_volume", "total_transactions", "volume_to_income_ratio"]),
    ("International Activity", ["num_intl_txns", "num_high_risk_country_txns", "pct_intl"]),
    ("Cash Activity", ["num_cash_txns", "pct_cash", "total_cash_amount"]),
]


def feature_columns(matrix: DataFrame) -> list[str]:
    """Numeric model inputs in column order (95 on the full matrix)."""
    return [f.name for f in matrix.schema.fields
            if f.name not in EXCLUDE and isinstance(f.dataType, T.NumericType)]


def train_classifier(matrix: DataFrame, label: str = "is_suspicious", seed: int = dims.GBT_PARAMS["seed"],
                     max_iter: int = dims.GBT_PARAMS["n_estimators"]) -> tuple[PipelineModel, list[str], DataFrame]:
    """F06 + F07: deterministic 80/20 split, assembler + GBT on the 80 %."""
    cols = feature_columns(matrix)
    data = stratified_split(matrix.withColumn("_label", F.col(label).cast("double")), label, 0.2, seed)
    asm = VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=max_iter,
                        maxDepth=dims.GBT_PARAMS["max_depth"], stepSize=dims.GBT_PARAMS["learning_rate"], seed=seed)
    model = Pipeline(stages=[asm, gbt]).fit(data.filter(~F.col("is_test")))
    return model, cols, data


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """probability of class 1 as ``risk_score`` (+ 0/1 prediction)."""
    out = model.transform(df)
    return (out.withColumn("risk_score", vector_to_array("probability")[1])
            .withColumn("prediction", F.col("prediction").cast("int"))
            .drop("_features", "rawPrediction", "probability"))


def enrich_alerts(alerts: DataFrame, scored: DataFrame) -> DataFrame:
    """scores of suspicious customers left-joined to the alerts."""
    s = scored.filter(F.col("is_suspicious") == 1).select(K, "risk_score")
    return alerts.join(s, K, "left")


def feature_importance(model: PipelineModel, cols: list[str], top: int = 10) -> DataFrame:
    """GBT feature importances, top ``top`` (a vector of #features)."""
    from pyspark.sql import SparkSession
    imp = model.stages[-1].featureImportances.toArray().tolist()
    ss = SparkSession.getActiveSession()
    df = ss.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # #features rows only
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def population_medians(matrix: DataFrame, features: list[str]) -> DataFrame:
    """One row of exact medians (linear interpolation, as numpy)."""
    return exact_quantiles(matrix, features, 0.5)


def counterfactuals(model: PipelineModel, matrix: DataFrame, cols: list[str],
                    threshold: float = dims.HIGH_RISK_THRESHOLD) -> DataFrame:
    """per customer × dimension: risk with that dimension set to the
    population medians, reduction, contribution %, and whether it flips."""
    dims_av = [(d, [f for f in fs if f in cols]) for d, fs in CF_DIMENSIONS]
    dims_av = [(d, fs) for d, fs in dims_av if fs]
    feats = sorted({f for _, fs in dims_av for f in fs})
    med = population_medians(matrix, feats).select(*[F.col(f).alias(f"_med_{f}") for f in feats])
    scen = F.explode(F.array(*[F.lit(i) for i in range(-1, len(dims_av))])).alias("_scen")
    x = attach_scalars(matrix, med).select("*", scen)
    for f in feats:
        ids = [i for i, (_, fs) in enumerate(dims_av) if f in fs]
        x = x.withColumn(f, F.when(F.col("_scen").isin(*ids), F.col(f"_med_{f}").cast(matrix.schema[f].dataType))
                         .otherwise(F.col(f)))
    s = score(model, x.drop(*[f"_med_{f}" for f in feats])).select(K, "_scen", "risk_score")
    cur = s.filter(F.col("_scen") == -1).select(K, F.col("risk_score").alias("current_risk_score"))
    names = F.array(*[F.lit(d) for d, _ in dims_av])
    cf = (s.filter(F.col("_scen") >= 0).join(cur, K)
          .select(K, F.element_at(names, F.col("_scen") + 1).alias("dimension"),
                  "current_risk_score", F.col("risk_score").alias("risk_with_normalization")))
    red = F.col("current_risk_score") - F.col("risk_with_normalization")
    return (cf.withColumn("risk_reduction", red)
            .withColumn("contribution_pct", F.when(F.col("current_risk_score") > 0,
                                                   red / F.col("current_risk_score") * 100).otherwise(F.lit(0.0)))
            .withColumn("would_flip_decision", (F.col("risk_with_normalization") < threshold)
                        & (F.col("current_risk_score") >= threshold)))


def counterfactual_summary(cf: DataFrame, threshold: float = dims.HIGH_RISK_THRESHOLD) -> DataFrame:
    """top-2 dimensions by contribution, their sum, total explained,
    barely crossed (|risk − 0.7| < 0.1)."""
    w = Window.partitionBy(K).orderBy(F.col("contribution_pct").desc(), F.col("dimension"))
    r = cf.withColumn("_rk", F.row_number().over(w))  # 8 rows per customer
    return r.groupBy(K).agg(
        F.first("current_risk_score").alias("current_risk_score"),
        F.sort_array(F.collect_list(F.when(F.col("_rk") <= 2, F.struct("_rk", "dimension")))).alias("_top"),
        F.round(F.sum(F.when(F.col("_rk") <= 2, F.col("contribution_pct")).otherwise(0.0)), 1).alias("top_2_contribution_pct"),
        F.round(F.sum("contribution_pct"), 1).alias("total_explained_pct"),
    ).select(K, "current_risk_score", F.col("_top.dimension").alias("top_risk_dimensions"),
             "top_2_contribution_pct", "total_explained_pct",
             (F.col("current_risk_score") >= threshold).alias("sar_triggered"),
             (F.abs(F.col("current_risk_score") - threshold) < 0.1).alias("barely_crossed_threshold"))


def counterfactual_text(cf: DataFrame, summary: DataFrame, threshold: float = dims.HIGH_RISK_THRESHOLD) -> DataFrame:
    """the counterfactual report text per customer (dimension lines in
    contribution order)."""
    line = F.format_string("%s [%.1f%% of risk] %s | risk if normalized %.2f%% (reduction %.2f%%)",
                           F.col("dimension"), F.col("contribution_pct"),
                           F.when(F.col("would_flip_decision"), "WOULD FLIP").otherwise(""),
                           F.col("risk_with_normalization") * 100, F.col("risk_reduction") * 100)
    lines = cf.groupBy(K).agg(F.sort_array(F.collect_list(F.struct((-F.col("contribution_pct")).alias("_o"),
                                                                      F.col("dimension"), line.alias("l")))).alias("_ls"))
    j = summary.join(lines, K)
    txt = F.concat_ws("\n",
                      F.lit("COUNTERFACTUAL SAR SIMULATION"),
                      F.format_string("Customer ID: %s", F.col(K).cast("string")),
                      F.format_string("Current Risk Score: %.2f%%", F.col("current_risk_score") * 100),
                      F.concat(F.lit("SAR Triggered: "), F.when(F.col("sar_triggered"), "YES").otherwise("NO")),
                      F.format_string("Threshold: %.0f%%", F.lit(threshold * 100)),
                      F.lit("DIMENSION ANALYSIS:"),
                      F.array_join(F.col("_ls.l"), "\n"),
                      F.lit("SUMMARY:"),
                      F.concat(F.lit("Top drivers: "), F.array_join("top_risk_dimensions", ", ")),
                      F.format_string("These explain %.0f%% of the risk", F.col("top_2_contribution_pct")),
                      F.concat(F.lit("Barely crossed threshold: "),
                               F.when(F.col("barely_crossed_threshold"), "YES").otherwise("NO")))
    return j.select(K, txt.alias("report"))

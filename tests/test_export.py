"""The rows of an alert are written together."""
from pathlib import Path

from pyspark.sql import functions as F

from driftwatch.sources import loaders as LD


def test_an_alerts_rows_lie_in_one_file(spark, tmp_path):
    df = spark.range(4000).repartition(8).select((F.col("id") % 40).alias("alert_id"), F.col("id").cast("string").alias("transaction_id"),
                                                 (F.col("id") * 1.5).alias("amount"))
    LD.export_alert_transactions(df, str(tmp_path / "x"))
    folders = sorted(p for p in (tmp_path / "x").iterdir() if p.is_dir())
    assert len(folders) == 40 and all(len(list(p.glob("*.csv"))) == 1 for p in folders)
    back = LD.read_alert_transactions(spark, str(tmp_path / "x"), df.drop("alert_id").schema)
    rows = lambda d: sorted((r["alert_id"], r["transaction_id"], r["amount"]) for r in d.collect())
    assert rows(back) == rows(df)

"""Consecutive ids (0, 1, 2, …) in a global order without a single-task window.

The frame is range-partitioned by the order (a distributed sort); each
partition numbers its own rows, and a tiny table of per-partition counts
(one row per partition, broadcast) turns local numbers into global offsets.
The numbered frame is checkpointed before it is read twice.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consecutive_index(df: DataFrame, order_cols: list, out: str = "idx") -> DataFrame:
    from driftwatch.session import cut_lineage
    s = df.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    # materialised once: the partition ids and local numbers must be the same
    # rows in both branches below, whatever the upstream order was
    s = cut_lineage(s.withColumn("_rn", F.row_number().over(w)))
    counts = s.groupBy("_pid").agg(F.max("_rn").alias("_c"))
    offs = counts.select("_pid", F.coalesce(
        F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))  # one row per partition
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_pid", "_rn", "_off"))


def md5_int(*cols) -> F.Column:
    """Non-negative 32-bit integer from the md5 text of the columns (DuckDB:
    ``('0x' || substr(md5(s), 1, 8))::BIGINT``)."""
    s = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")

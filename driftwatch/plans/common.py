"""Helpers for the registered queries (presentation only: rounding for the
cross-engine check, cached canonical views per session and data folder)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.session import ensure_utc, ship_package


def tier_round(c) -> F.Column:
    """Magnitude-tiered rounding for the cross-engine check: 6 decimals below
    100, 4 below 1e5, 2 below 1e8, else 0, so that sums taken in a different
    order by another engine land on the same value."""
    x = c.cast("double")
    a = F.abs(x)
    # money sums can sit exactly on a rounding half; a relative nudge of 1e-12
    # (far above the summation noise, far below the rounding step) moves them
    # off it identically in both engines
    xn = x * F.lit(1.000000000001)
    return (F.when(a < 100, F.round(xn, 6)).when(a < 100000, F.round(xn, 4))
            .when(a < 100000000, F.round(xn, 2)).otherwise(F.round(xn, 0)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (``tier_round``) for the cross-engine check."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            cols.append(tier_round(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def prep(spark: SparkSession) -> None:
    ensure_utc(spark)
    ship_package(spark)

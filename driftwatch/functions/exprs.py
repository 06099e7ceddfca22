"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_HOUR = 3_600 * US_PER_SECOND
US_PER_DAY = 86_400 * US_PER_SECOND


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_micros(c) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column (session zone is UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def day_number(us) -> Column:
    """Whole UTC days since 1970-01-01 of an epoch-microsecond column."""
    return F.floor(col(us) / F.lit(US_PER_DAY)).cast("long")


def weekday_from_us(us) -> Column:
    """Monday = 0 … Sunday = 6 (1970-01-01 was a Thursday)."""
    return F.pmod(day_number(us) + F.lit(3), F.lit(7)).cast("int")


def hash_int(*parts) -> Column:
    """Deterministic non-negative 32-bit hash from md5 text (same in DuckDB)."""
    s = F.concat_ws("|", *[col(p).cast("string") for p in parts]) if len(parts) > 1 else col(parts[0]).cast("string")
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def pick(options: list, index: Column) -> Column:
    """``options[index]`` for a small fixed list (inlined as a literal array)."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + F.lit(1))


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Inline map lookup with a default (no join, stays in codegen)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    # try_element_at: NULL for a missing key whatever the ANSI setting
    v = F.try_element_at(m, key) if mapping else F.lit(None)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def normalize(v, lo: float, hi: float) -> Column:
    """clip((v - lo) / (hi - lo), 0, 1); 0.5 when lo == hi."""
    if hi == lo:
        return F.lit(0.5)
    x = (col(v) - F.lit(float(lo))) / F.lit(float(hi - lo))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def entropy_agg(count_col="n") -> Column:
    """Shannon entropy (log2) of a group of category counts, as one aggregate:
    H = log2(T) - sum(c * log2 c) / T   with T = sum(c).  0 for an empty group."""
    c = col(count_col).cast("double")
    t = F.sum(c)
    h = F.log2(t) - F.sum(c * F.log2(c)) / t
    return F.coalesce(F.greatest(h, F.lit(0.0)), F.lit(0.0))


def r6(c) -> Column:
    return F.round(col(c).cast("double"), 6)


def attach_scalars(df, one_row, cols: list[str] | None = None):
    """Add the columns of a one-row aggregate frame to every row of ``df`` as
    a scalar subquery (evaluated once, inlined as a value; Spark raises an
    error if the frame ever holds more than one row)."""
    cols = cols or one_row.columns
    sc = one_row.select(F.struct(*cols).alias("_sc")).scalar()
    return df.withColumn("_sc1", sc).select("*", *[F.col(f"_sc1.{c}").alias(c) for c in cols]).drop("_sc1")

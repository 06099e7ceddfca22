"""Helpers shared by the operators of this package."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.session import ensure_utc, ship_package

#: Java class of the blanks between words; words are the runs of all else.
BLANK = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and no other letter. ``lower`` does it for plain ASCII texts;
    the slower ``translate`` is kept for the rest."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column, between: str = BLANK) -> Column:
    """Runs of characters outside the class ``between``; a null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), between + "+"), "")


def bind(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(doc_id: str, text: str) -> Column:
    """128 bits that identify a row by its content: repeated rows share it and
    get the same result, rows that share only the id do not."""
    return F.struct(
        F.xxhash64(F.col(doc_id).isNull(), doc_id, F.col(text).isNull(), text).alias("a"),
        F.xxhash64(F.lit(17), F.col(text).isNull(), text, doc_id).alias("b"))

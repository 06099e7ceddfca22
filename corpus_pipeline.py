"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that its predecessor kept and returns those that it
keeps, with the same columns; the last returns the packed pieces. ``run`` writes every
stage's result as Parquet in the shared folder and reads it again, so a lost
executor costs one stage's tasks at most.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import decontaminate, fm_dedup, ngram_join, packing, quality_rules
from driftwatch.llm.common import row_key, table
from driftwatch.llm.queries import END_ID, vocabulary
from driftwatch.session import checkpoint_dir, ensure_utc, ship_package

#: Columns that a stage adds to documents for a join; dropped again.
KEY = "__pipeline_key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules reject go."""
    kept = quality_rules.judge(docs).where("kept").select(F.col("_key").alias(KEY)).distinct()
    return docs.withColumn(KEY, row_key("doc_id", "text")).join(kept, KEY, "left_semi").drop(KEY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the first document of each group of near duplicates stays (repeated rows become one)."""
    stays = ngram_join.near_duplicates(docs).where("stays").select(F.col("k").alias(KEY)).distinct()
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(ngram_join.LAST)), F.coalesce("text", F.lit("")))
    return docs.withColumn(KEY, key).join(stays, KEY, "left_semi").dropDuplicates([KEY]).drop(KEY)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: words of passages that an earlier document has go; a text that loses some becomes its
    other words, joined by one space (and ``n_chars`` follows); one that loses all goes; others stay as they are."""
    cut = fm_dedup.dedup(docs).where("n_removed > 0").dropDuplicates(["doc_id", "h"])
    cut = cut.select(F.struct(F.col("doc_id").alias("a"), F.col("h").alias("b")).alias(KEY),
                     F.decode("kept", "UTF-8").alias(KEY + "_text"), (F.col("n_removed") == F.col("n_words")).alias(KEY + "_all"))
    key = F.struct(F.col("doc_id").cast("long").alias("a"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("b"))
    both = docs.withColumn(KEY, key).join(cut.withColumnRenamed(KEY, KEY + "_cut"), F.col(KEY).eqNullSafe(F.col(KEY + "_cut")), "left")
    both = both.where(~F.coalesce(KEY + "_all", F.lit(False))).withColumn("text", F.coalesce(KEY + "_text", "text"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(KEY + "_text").isNotNull(), F.char_length(KEY + "_text")).otherwise(F.col("n_chars"))
        both = both.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a window of a benchmark item go."""
    bad = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("_key").alias(KEY)).distinct()
    return docs.withColumn(KEY, row_key("doc_id", "text")).join(bad, KEY, "left_anti").drop(KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of at most 1,024 tokens in sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), END_ID, blanks="lead", lower=False)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]
#: SQL has no expression for the fitted rules, the index or the packing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    ship_package(spark)
    df = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, df, sf_dir).write.parquet(f"{folder}/{number}")
        df = spark.read.parquet(f"{folder}/{number}")
    return df

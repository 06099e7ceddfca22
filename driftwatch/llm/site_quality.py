"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes log-likelihood ratio over binned
features of its text, fitted on all labelled documents (the bins are few, so the
fitted table is too). Evidence about its place comes from all documents: the
share of good ones (labels where known, else the document classifier's
probability) per host and per path of a host, each shrunk: a path towards its host, a
host towards the corpus,

    m_host = (good + k_host m_all) / (n + k_host),  m_path = (good + k_path m_host) / (n + k_path)

with the strengths k estimated from the spread between groups (moments of the
beta-binomial), so a sparse site hardly moves from the global prior. The
posterior of a document has the odds of its path's share times its own likelihood ratio.

All statistics are grouped aggregates over all rows with map-side combine; a host
with a third of all rows is one partial row per task.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import words
from driftwatch.session import cut_lineage

FEATURES = ["length", "word_length", "symbols", "capitals", "exclaim", "lines", "variety", "closing"]
#: A shrinkage strength is kept between these numbers of documents.
WEAKEST, STRONGEST = 2.0, 1e6


def features(text: Column, df: DataFrame) -> DataFrame:
    """``df`` with one small integer per feature (-1 where there is nothing to measure)."""
    df = df.withColumn("_t", F.coalesce(text, F.lit("")))
    df = df.withColumn("_w", words(F.col("_t"))).withColumn(
        "_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n, lines = F.size("_w"), F.size("_l")
    count = lambda p: F.regexp_count("_t", F.lit(p))

    def share(part: Column, whole: Column, steps: int, most: int) -> Column:
        return F.when(whole > 0, F.least(F.floor(steps * part / whole), F.lit(most))).otherwise(-1).cast("int")

    closed = F.size(F.filter("_l", lambda x: x.rlike(r"[.!?:;\"')\]]\s*$")))
    return df.select("*", *[c.alias("f_" + k) for k, c in {
        "length": F.floor(F.log2(n + F.lit(1))).cast("int"),
        "word_length": share(F.char_length(F.array_join("_w", "")), n, 2, 40),
        "symbols": share(count(r"[#*$%&|<>]"), n, 10, 20),
        "capitals": share(count(r"[A-ZÀ-Þ]"), F.char_length("_t"), 20, 20),
        "exclaim": share(count("!"), n, 10, 20),
        "lines": share(lines - F.size(F.array_distinct("_l")), lines, 10, 10),
        "variety": share(F.size(F.array_distinct("_w")), n, 20, 20),
        "closing": share(closed, lines, 10, 10),
    }.items()]).drop("_t", "_w", "_l")


def _strength(groups: DataFrame, mean: float) -> float:
    """k of groups (n, good): what the spread of their shares beyond chance leaves."""
    share = F.col("good") / F.col("n")
    row = groups.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                                    F.sum(F.col("n") * (share - mean) ** 2).alias("spread")).first()
    if not row["g"] or row["g"] < 2:
        return STRONGEST
    chance, total = mean * (1 - mean), row["n"]
    even = total - row["nn"] / total
    excess = (row["spread"] - (row["g"] - 1) * chance) / even if even > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, chance / excess - 1)) if excess > 0 else STRONGEST


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
             path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """Rows ``(id_col, evidence, site_share, quality, kept)``, one per row of ``docs``.

    Null hosts or paths are a group of their own; a null or empty text has only its
    length as evidence; null ids have no label; several labels of one id are
    averaged (a half counts as good), null ones are ignored; without labels every probability
    is a half and everything is kept; repeated rows give repeated rows; an empty table gives none.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("null"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    base = docs.select(F.col(id_col).alias("_id"), name(host_col).alias("_host"), name(path_col).alias("_path"), F.col(text_col).alias("_text"))
    base = features(F.col("_text"), base).drop("_text")
    base = cut_lineage(base.join(known, "_id", "left"))
    # at most some hundred rows: (feature, bin, label)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col("f_" + k).alias("b")) for i, k in enumerate(FEATURES)]))
    table = base.where("_y is not null").select("_y", pairs.alias("p")).groupBy("p.f", "p.b", "_y").count().collect()
    n = {y: sum(r["count"] for r in table if r["_y"] == y) / len(FEATURES) for y in (0, 1)}
    evidence, prior = F.lit(0.0), (n[1] + 1) / (n[0] + n[1] + 2)
    if n[0] and n[1]:
        for i, k in enumerate(FEATURES):
            seen = {(r["b"], r["_y"]): r["count"] for r in table if r["f"] == i}
            bins = {b for b, _ in seen}
            term = F.lit(0.0)
            for b in sorted(bins):
                p = [(seen.get((b, y), 0) + 0.5) / (n[y] + 0.5 * len(bins)) for y in (0, 1)]
                term = F.when(F.col("f_" + k) == b, math.log(p[1] / p[0])).otherwise(term)
            evidence = evidence + term
    scored = base.select("_id", "_host", "_path", "_y", F.round(evidence, 6).alias("evidence"))
    odds = lambda p: F.log(p / (1 - p))
    logistic = lambda z: 1 / (1 + F.exp(-z))
    soft = F.coalesce(F.col("_y").cast("double"), logistic(F.lit(math.log(prior / (1 - prior))) + F.col("evidence")))
    paths = cut_lineage(scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum(soft).alias("good")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    every = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = (every["good"] + prior) / (every["n"] + 1) if every["n"] else prior
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    k_host = _strength(hosts.select(F.col("hn").alias("n"), F.col("hgood").alias("good")), mean)
    k_path = _strength(paths, mean)
    hosts = hosts.select("_host", ((F.col("hgood") + k_host * mean) / (F.col("hn") + k_host)).alias("m"))
    sites = paths.join(hosts, "_host").select(
        "_host", "_path", F.round((F.col("good") + k_path * F.col("m")) / (F.col("n") + k_path), 6).alias("site_share"))
    out = scored.join(sites, ["_host", "_path"])
    inside = F.greatest(F.least(F.col("site_share"), F.lit(1 - 1e-6)), F.lit(1e-6))
    quality = F.round(logistic(odds(inside) + F.col("evidence")), 6)
    return out.select(F.col("_id").alias(id_col), "evidence", "site_share", quality.alias("quality"), (quality >= threshold).alias("kept"))

"""URL filter by the likelihood ratio of two character models (DataFrame operations only).

URLs that a host/path rule decides are the examples: allowed ones train one
variable-order Markov model, blocked ones the other. Both are smoothed by
Witten-Bell interpolation over the orders 0 to ``order``:

    P_k(c | ctx) = (n(ctx c) + T(ctx) P_{k-1}(c | ctx')) / (n(ctx) + T(ctx))

with T the number of different followers; an unseen context falls back to the
next shorter one, and below order 0 stands the uniform distribution. A URL
without a rule gets the difference of the two log-likelihoods, divided by its
length, and is allowed when that is not below a threshold. The threshold is
calibrated on a fifth of the examples that was kept out of training: it gives
the best mean of the two classes' hit rates.

All counts come from one aggregate of (class, gram) rows with map-side combine;
lower orders are sums of it. Scoring joins the URLs' grams with the table of
per-gram differences; as some grams stand in every URL, both sides are salted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import UPPER

#: (host, path, verdict) in the order of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
START, END = "\u0002", "\u0003"
SALTS = 16
#: Probability of any character below order 0.
UNIFORM = 1 / 256
#: Scores are counted in steps of 1/200 between -20 and 20 to find the threshold.
STEP, EDGE = 200, 4000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, UPPER.lower()), F.regexp_extract(u, pattern, 2)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return rule, verdict


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """One row per character of ``_s`` and the end mark: the character with ``order`` before it."""
    chars = F.split(F.concat(F.lit(START * order), F.translate("_s", START + END, ""), F.lit(END)), "")
    rows = rows.withColumn("_ch", chars)
    at = lambda i: F.concat(*[F.col("_ch")[i + k] for k in range(order + 1)])
    last = F.size("_ch") - (order + 1)
    return rows.withColumn("_g", F.explode(F.transform(F.sequence(F.lit(0), last), at))).drop("_ch")


def _differences(train: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(_g, _d): log P(allow) - log P(block) of each wanted gram."""
    out = wanted.withColumns({"_pa": F.lit(UNIFORM), "_pb": F.lit(UNIFORM)})
    for k in range(order + 1):
        short = F.substring("_g", order + 1 - k, k + 1)
        hits = train.groupBy(short.alias("_k")).agg(F.sum("_na").alias("_ha"), F.sum("_nb").alias("_hb"))
        ctx = hits.groupBy(F.substring("_k", 1, k).alias("_x")).agg(
            F.sum("_ha").alias("_ca"), F.sum("_hb").alias("_cb"),
            F.count_if(F.col("_ha") > 0).alias("_ta"), F.count_if(F.col("_hb") > 0).alias("_tb"))
        out = (out.withColumn("_k", short).withColumn("_x", F.substring("_k", 1, k))
               .join(hits, "_k", "left").join(ctx, "_x", "left"))
        for m in ("a", "b"):
            z = lambda c: F.coalesce(F.col(c), F.lit(0))
            mixed = (z("_h" + m) + z("_t" + m) * F.col("_p" + m)) / (z("_c" + m) + z("_t" + m))
            out = out.withColumn("_p" + m, F.when(z("_c" + m) > 0, mixed).otherwise(F.col("_p" + m)))
        out = out.drop("_k", "_x", "_ha", "_hb", "_ca", "_cb", "_ta", "_tb")
    return out.select("_g", (F.log("_pa") - F.log("_pb")).alias("_d"))


def _threshold(scores: DataFrame) -> float:
    """Cut with the best mean hit rate over held-out examples (a table of at most 2 * EDGE + 1 rows)."""
    step = F.greatest(F.least(F.floor(F.col("_score") * STEP), F.lit(EDGE)), F.lit(-EDGE))
    rows = scores.groupBy(step.alias("b")).agg(
        F.count_if(F.col("_class") == "allow").alias("a"), F.count_if(F.col("_class") == "block").alias("r"))
    table = sorted((r["b"], r["a"], r["r"]) for r in rows.collect())
    good, bad = sum(a for _, a, _ in table), sum(r for _, _, r in table)
    if not good or not bad:
        return 0.0
    best, cut, above, below = -1.0, 0.0, good, 0
    for b, a, r in table:
        rate = above / good + below / bad
        if rate > best or (rate == best and abs(b) < abs(cut * STEP)):
            best, cut = rate, b / STEP
        above, below = above - a, below + r
    return cut


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                order: int = 4, seed: int = 7, whole: bool = False) -> DataFrame:
    """Rows ``(id_col, host, path, rule, verdict, score)``, one per row of ``pages``.

    ``score`` is null where a rule decides. With ``whole`` the models are trained
    on and score the URL as it is, with scheme, query and fragment; without it,
    only host and path. The rules look at host and path either way. A null or
    malformed URL has an empty host and path; null is scored as the empty string,
    and so is a malformed one unless ``whole``. A null id stays null;
    repeated rows give repeated rows; without examples of both classes the
    threshold is 0 and every URL without a rule is allowed. An empty table
    gives no rows.
    """
    host, path = split_url(F.col(url_col))
    text = F.coalesce(F.col(url_col), F.lit("")) if whole else F.concat(host, path)
    base = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), text.alias("_s"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("_class", verdict)
    urls = base.groupBy("_s").agg(F.max("_class").alias("_class"), F.count(F.lit(1)).alias("_n"))
    urls = urls.withColumn("_held", F.col("_class").isNotNull() & (F.pmod(F.xxhash64(F.lit(seed), "_s"), F.lit(5)) == 0))
    train = (_grams(urls.where(F.col("_class").isNotNull() & ~F.col("_held")), order).groupBy("_g")
             .agg(F.sum(F.when(F.col("_class") == "allow", F.col("_n")).otherwise(0)).alias("_na"),
                  F.sum(F.when(F.col("_class") == "block", F.col("_n")).otherwise(0)).alias("_nb")))
    ask = urls.where(F.col("_class").isNull() | F.col("_held"))
    asked = _grams(ask.select("_s", F.xxhash64("_s").alias("_k1"), F.hash("_s").alias("_k2")), order).drop("_s")
    diff = _differences(train, asked.select("_g").distinct(), order)
    diff = diff.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = asked.withColumn("_salt", F.pmod("_k2", F.lit(SALTS)))
    score = (salted.join(diff, ["_g", "_salt"]).groupBy("_k1", "_k2")
             .agg(F.round(F.sum("_d") / F.count(F.lit(1)), 9).alias("_score")))
    scored = (ask.withColumn("_k1", F.xxhash64("_s")).withColumn("_k2", F.hash("_s"))
              .join(score, ["_k1", "_k2"]).select("_s", "_class", "_score"))
    from driftwatch.session import cut_lineage
    scored = cut_lineage(scored)
    cut = _threshold(scored.where(F.col("_class").isNotNull()))
    free = scored.where(F.col("_class").isNull()).select("_s", "_score")
    said = F.when(F.col("_score") >= cut, "allow").otherwise("block")
    return base.join(free, "_s", "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_class", said).alias("verdict"), F.col("_score").alias("score"))

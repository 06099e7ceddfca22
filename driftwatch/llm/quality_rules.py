"""Quality rules combined by weak supervision (DataFrame operations only).

Eight rules look at counts of a document and vote good (1), bad (-1) or abstain
(0). Expectation-maximisation estimates, without labels, how often each rule
votes which way on good and on bad documents; the posterior probability that a
document is good then replaces "all rules must pass".

EM needs only how many documents have each pattern of votes: a grouped count
of at most 3^8 = 6,561 rows however large the corpus, which is what the driver
reads. The fitted log-odds go back into the plan as literals.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import bind, row_key, words
from driftwatch.session import cut_lineage

SYMBOLS = r"[#*$%&|<>]"
GRAM = 8
RULES = ["length", "word_length", "symbols", "lines", "repeats", "capitals", "exclaim", "closing"]


def _window_hashes(w: Column) -> Column:
    """Hash of each window of 8 consecutive words, built by doubling: 1, 2, 4, 8."""
    def double(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))
    one = F.transform(w, lambda x: F.xxhash64(x))
    eight = bind(one, lambda h1: bind(double(h1, 1), lambda h2: bind(double(h2, 2), lambda h4: double(h4, 4))))
    return F.slice(eight, F.lit(1), F.greatest(F.size(w) - (GRAM - 1), F.lit(0)))  # the last seven are cut short


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more: sort the windows by hash,
    mark those with an equal neighbour, sort the marked ones by place, and add
    up what each covers before the next begins."""
    def marked(s: Column) -> Column:
        same = lambda e, k, d: F.coalesce(F.get(s, k + d)["h"] == e["h"], F.lit(False))
        twice = F.transform(s, lambda e, k: F.when(same(e, k, -1) | same(e, k, 1), e["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def covered(f: Column) -> Column:
        step = lambda p, k: F.least(F.lit(GRAM), F.coalesce(F.get(f, k + 1) - p, F.lit(GRAM))).cast("long")
        return F.aggregate(F.transform(f, step), F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bind(placed, lambda s: bind(marked(s), covered))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the contract's counts and those that only the rules use."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), t.alias("_t")).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines).withColumn("_h", _window_hashes(F.col("_w")))
    n = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    repeats = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _repeat_words(F.col("_h"))).otherwise(F.lit(0).cast("long"))
    return df.select(
        "_id", "_key",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        n(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        n(r"[A-ZÀ-Þ]").alias("n_upper"),
        n(r"[!]").alias("n_exclaim"),
        F.size(F.filter("_l", lambda x: x.rlike(r"[.!?:;\"')\]]\s*$"))).cast("long").alias("n_closed"))


def votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains; a rule without anything to look at abstains.

    Most rules know only one kind of junk each and abstain on all other texts:
    that a text has no repeated lines says little for it.
    """
    w, c, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    share = lambda a, b: F.when(b > 0, F.col(a) / b)

    def vote(bad: Column, good: Column | None = None) -> Column:
        said = F.when(bad, -1)
        return (said if good is None else said.when(good, 1)).otherwise(0)

    mean, sym, dup = share("word_chars", w), share("n_symbols", w), share("n_dup_lines", lines)
    rep, cap, exc, end = share("n_repeat_words", w), share("n_upper", c), share("n_exclaim", w), share("n_closed", lines)
    return {
        "length": vote(w < 20, w >= 50),
        "word_length": vote((mean < 2) | (mean > 13)),
        "symbols": vote(sym > 0.1),
        "lines": vote(dup > 0.4),
        "repeats": vote(rep > 0.3),
        "capitals": vote(cap > 0.4),
        "exclaim": vote(exc > 0.3),
        "closing": F.when(end >= 0.8, 1).otherwise(0),
    }


#: Before the data speak, a vote is right nine times in ten and four documents in
#: five are good; these beliefs weigh as much as BELIEF votes for each vote cast.
RIGHT, GOOD, BELIEF = 0.9, 0.8, 3.0


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tol: float = 1e-9):
    """EM over vote patterns: (log-odds of good without votes, per rule and vote what it adds).

    E-step: the posterior of each pattern. M-step: the accuracy of each rule's
    good and bad votes, as the share of them that the posteriors bear out, and
    the share of good documents, both drawn towards the beliefs above (without
    them a kind of junk that only one rule knows would leave that rule's accuracy
    open). A vote adds the log-odds of its accuracy less those of its class at
    large, so a rule that votes on nearly everything adds nearly nothing. Ends
    when no accuracy moves by ``tol``, or after ``rounds``, with that round's estimate.

    The beliefs hold BELIEF / (1 + BELIEF) = 75 % of each estimate however large
    the corpus: accuracies stay within [0.675, 0.925] and the share of good
    documents within [0.6, 0.85]. So one bad vote with no good vote always
    rejects, and a rule that is wrong on most of its documents keeps a weight.
    Beliefs that fade with the votes leave EM without a right answer on this
    data (figures in the README).
    """
    good, right = GOOD, [{v: RIGHT for v in (-1, 1)} for _ in RULES]
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        base, adds = _weights(good, right)
        post = [(x, n, _posterior(x, base, adds)) for x, n in patterns]
        old, new = (good, right), []
        if total:
            good = (sum(n * p for _, n, p in post) / total + BELIEF * GOOD) / (1 + BELIEF)
        for j in range(len(RULES)):
            accuracy = {}
            for v in (-1, 1):
                cast = sum(n for x, n, _ in post if x[j] == v)
                borne = sum(n * (p if v == 1 else 1 - p) for x, n, p in post if x[j] == v)
                accuracy[v] = (borne / cast + BELIEF * RIGHT) / (1 + BELIEF) if cast else RIGHT
            new.append(accuracy)
        right = new
        if max(abs(good - old[0]), *(abs(a[v] - b[v]) for a, b in zip(right, old[1]) for v in (-1, 1))) < tol:
            break
    return _weights(good, right)


def _weights(good: float, right: list[dict[int, float]]):
    return _logit(good), [{1: _logit(a[1]) - _logit(good), -1: -(_logit(a[-1]) - _logit(1 - good))} for a in right]


def _posterior(x, base: float, adds) -> float:
    z = base + sum(a[v] for v, a in zip(x, adds) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows ``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality, _key)``, one per row of ``docs`` (``_key`` as ``common.row_key``).

    An abstaining rule leaves the odds alone. A null or empty text has no words
    and fails the base rule; a null id stays null; repeated rows give repeated
    rows and count as often in EM; an empty table gives no rows.
    """
    v = votes()
    df = counts(docs, id_col, text_col).select("*", *[c.cast("int").alias("_v_" + k) for k, c in v.items()])
    df = cut_lineage(df)  # the counts cost most: once for EM, once for the result
    cols = ["_v_" + k for k in RULES]
    seen = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).collect()
    base, adds = fit(sorted((tuple(r[c] for c in cols), r["_n"]) for r in seen))
    odds = F.lit(base)
    for c, a in zip(cols, adds):
        odds = odds + F.when(F.col(c) == 1, a[1]).when(F.col(c) == -1, a[-1]).otherwise(0.0)
    quality = 1 / (1 + F.exp(-odds))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"),
        F.round(quality, 9).alias("quality"), "_key")

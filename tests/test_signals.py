"""Hand-made edge cases for the behavioural signals."""
import math

import pytest
from pyspark.sql import functions as F

from driftwatch.functions.exprs import US_PER_DAY, US_PER_HOUR
from driftwatch.operators import signals as S

SCHEMA = "customer_id long, ts_us long, amount double, counterparty string"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_amount_guards(spark):
    # four rows -> zeros; five positive constant amounts -> zero skew/kurtosis
    four = _df(spark, [(1, i * US_PER_DAY, 9000.0, "a") for i in range(4)])
    r = _one(S.amount_anomaly(four))
    assert all(r[c] == 0.0 for c in S.AMOUNT_COLS)
    five = _df(spark, [(1, i * US_PER_DAY, 9000.5, "a") for i in range(5)])
    r = _one(S.amount_anomaly(five))
    assert r["structuring_score"] == 1.0 and r["round_amount_ratio"] == 0.0
    assert r["amount_skewness"] == 0.0 and r["amount_kurtosis"] == 0.0
    # Benford: all first digits 9 -> 1 - e9 + (1 - e9) ... full L1 sum
    e = [math.log10(1 + 1 / d) for d in range(1, 10)]
    assert r["benford_deviation"] == pytest.approx(sum(e[:8]) + abs(1 - e[8]))


def test_burst_small_and_gaps(spark):
    two = _df(spark, [(1, 0, 1.0, None), (1, US_PER_HOUR, 1.0, None)])
    r = _one(S.temporal_burst(two))
    assert r["burst_events"] == 0 and r["burstiness_index"] == 0.0
    # gaps 1h, 1h, 48h: mean 50/3, sample std
    ts = [0, US_PER_HOUR, 2 * US_PER_HOUR, 50 * US_PER_HOUR]
    r = _one(S.temporal_burst(_df(spark, [(1, t, 1.0, None) for t in ts])))
    gaps = [1.0, 1.0, 48.0]
    m = sum(gaps) / 3
    s = math.sqrt(sum((g - m) ** 2 for g in gaps) / 2)
    assert r["burstiness_index"] == pytest.approx((s - m) / (s + m))
    assert r["burst_events"] == 2 and r["max_daily_count"] == 3
    assert r["mean_daily_count"] == pytest.approx(2.0)


def test_entropy_short_history_and_empty_window(spark):
    # exactly 59 whole days -> one window over all rows
    rows = [(1, 0, 10.0, "a"), (1, 59 * US_PER_DAY, 20.0, "b")]
    r = _one(S.entropy_drift(_df(spark, rows), 30))
    assert r["num_windows"] == 1 and r["amount_entropy_drift"] == 0.0
    assert r["mean_amount_entropy"] == pytest.approx(1.0)
    # 100 days with an empty middle window: kept windows 0 and 2 are consecutive
    rows = [(1, 0, 10.0, "a"), (1, US_PER_DAY, 10.0, "a"),
            (1, 61 * US_PER_DAY, 10.0, "a"), (1, 62 * US_PER_DAY, 50.0, "b"),
            (1, 100 * US_PER_DAY, 10.0, "a")]
    r = _one(S.entropy_drift(_df(spark, rows), 30))
    assert r["num_windows"] == 2
    assert r["amount_entropy_drift"] == pytest.approx(1.0)
    assert r["counterparty_entropy_drift"] == pytest.approx(1.0)


def test_expansion(spark):
    # valid cps a (day 0), b (day 31), c (day 65); windows while start+30d <= max+1d
    rows = [(1, 0, 1.0, "a"), (1, 31 * US_PER_DAY, 1.0, "b"), (1, 65 * US_PER_DAY, 1.0, "c"),
            (1, 66 * US_PER_DAY, 1.0, ""), (1, 67 * US_PER_DAY, 1.0, None)]
    r = _one(S.counterparty_expansion(_df(spark, rows), 30))
    # max valid = 65d -> windows k with (k+1)*30 <= 66 -> k = 0, 1; c (k=2) not counted
    assert r["total_unique_counterparties"] == 2
    assert r["counterparty_expansion_rate"] == pytest.approx(1.0)
    assert r["counterparty_novelty_slope"] == pytest.approx(0.0)
    only_null = _df(spark, [(2, 0, 1.0, None), (2, US_PER_DAY, 1.0, "")])
    r = _one(S.counterparty_expansion(only_null, 30))
    assert r["total_unique_counterparties"] == 0 and r["counterparty_expansion_rate"] == 0.0


def _reference(rows, w_days):
    """B06–B08 of one customer's (ts_us, amount, counterparty) rows in plain Python."""
    from collections import Counter
    rows = sorted(rows, key=lambda r: r[0])
    ts = [r[0] for r in rows]

    def h(values):
        n = len(values)
        return -sum(c / n * math.log2(c / n) for c in Counter(values).values()) if n >= 2 else 0.0

    def entropies(part):
        lo, hi = min(r[1] for r in part), max(r[1] for r in part)
        bins = [min(9, math.floor((r[1] - lo) / (hi + 1 - lo) * 10)) for r in part]
        return (h(bins), h([(r[0] // US_PER_DAY + 3) % 7 for r in part]), h([r[2] for r in part if r[2]]))

    w = w_days * US_PER_DAY
    if (ts[-1] - ts[0]) // US_PER_DAY < 2 * w_days:
        groups = [rows]
    else:
        by = {}
        for r in rows:
            k = (r[0] - ts[0]) // w
            if ts[0] + (k + 1) * w <= ts[-1]:
                by.setdefault(k, []).append(r)
        groups = [by[k] for k in sorted(by)]
    per = [entropies(g) for g in groups]
    out = {}
    for i, name in enumerate(("amount", "timing", "counterparty")):
        out[f"mean_{name}_entropy"] = sum(p[i] for p in per) / len(per)
        out[f"{name}_entropy_drift"] = max((abs(a[i] - b[i]) for a, b in zip(per, per[1:])), default=0.0)
    gaps = [(b - a) / US_PER_HOUR for a, b in zip(ts, ts[1:])]
    days = Counter(t // US_PER_DAY for t in ts)
    if len(rows) >= 3:
        m = sum(gaps) / len(gaps)
        out["inter_arrival_variance"] = sum((g - m) ** 2 for g in gaps) / (len(gaps) - 1)
        out["burst_events"], out["max_daily_count"] = sum(g < 24 for g in gaps), max(days.values())
        out["mean_daily_count"] = len(ts) / len(days)
    valid = [r for r in rows if r[2]]
    if len(valid) >= 2:
        first = {}
        for t, _, cp in valid:
            first.setdefault(cp, (t - valid[0][0]) // w)
        n = (valid[-1][0] + US_PER_DAY - valid[0][0]) // w
        new = [sum(k == i for k in first.values()) for i in range(n)]
        if n >= 1:
            out["total_unique_counterparties"], out["counterparty_expansion_rate"] = sum(new), sum(new) / n
        if n >= 2:
            mean = (n - 1) / 2
            out["counterparty_novelty_slope"] = sum((i - mean) * c for i, c in enumerate(new)) / sum((i - mean) ** 2 for i in range(n))
    return out


@pytest.fixture(scope="module")
def hot_rows():
    """A third of the rows belong to one customer; nulls, empty counterparties, equal times."""
    import random
    rng = random.Random(5)
    day = lambda: rng.randrange(0, 240) * US_PER_DAY + rng.choice([0, 1, 3, 9, 20]) * US_PER_HOUR + rng.randrange(3)
    who = [7] * 500 + [rng.randrange(20, 60) for _ in range(1000)]
    return [(c, day(), round(rng.uniform(5, 9500), 2), rng.choice(["a", "b", None, "", *map(str, range(30))])) for c in who]


def test_all_signals_with_a_hot_customer_equal_plain_python(spark, hot_rows):
    got = {r["customer_id"]: r.asDict() for r in S.all_signals(_df(spark, hot_rows), window_days=30).collect()}
    by = {}
    for c, *r in hot_rows:
        by.setdefault(c, []).append(r)
    assert set(got) == set(by)
    for c, rows in by.items():
        for name, value in _reference(rows, 30).items():
            assert got[c][name] == pytest.approx(value, abs=1e-9), (c, name)


def test_rows_are_never_dealt_by_customer_alone(spark, hot_rows):
    """Below every exchange on the customer alone stands an aggregate or a window over summaries of days, not raw rows."""
    import re
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = _df(spark, hot_rows)
        for out in (S.all_signals(df, window_days=30), S.entropy_drift(df), S.temporal_burst(df), S.counterparty_expansion(df),
                    S.grouped_entropies(df, ["customer_id"]), S.tumbling_window_index(df)):
            lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
            seen = 0
            for line, below in zip(lines, lines[1:]):
                if re.search(r"Exchange hashpartitioning\(customer_id#\d+L, \d+\)", line):
                    seen += 1
                    while re.search(r"(Project|Filter) ", below):
                        below = lines[lines.index(below) + 1]
                    assert re.search("Aggregate|Window", below), line + "\n" + below
            assert seen or out.columns[-1] == "win"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_customers_rows_are_spread(spark, hot_rows):
    parts = S.with_history(_df(spark, hot_rows)).where("customer_id = 7").repartition(16, "customer_id", S.CELL)
    sizes = [r["c"] for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
    assert sum(sizes) == 500 and max(sizes) < 100


def test_timeline_of_text_ids(spark, hot_rows):
    from driftwatch.operators import stability as ST
    df = spark.createDataFrame([(c, t, a, cp, "deposit" if i % 2 else "withdrawal", f"t{i}") for i, (c, t, a, cp) in enumerate(hot_rows)],
                               SCHEMA + ", transaction_type string, transaction_id string")
    name = F.col("customer_id").cast("string")
    a = ST.bsi_timeline(df).withColumn("customer_id", name).collect()
    b = ST.bsi_timeline(df.withColumn("customer_id", name)).collect()
    same = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert len(a) > 100 and same(a) == same(b)

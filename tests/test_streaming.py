"""M04 (stateful stream over files) equals M02 (batch window function)."""
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from driftwatch.operators import stability as ST
from driftwatch.streaming import monitor as MS

US_DAY = 86_400_000_000
START = 1000 * US_DAY


def _rows(ids, windows=8):
    return [(c, START + j * 3 * US_DAY, 80.0 - (25.0 if (n + j) % 4 == 0 else 0.0) - j) for n, c in enumerate(ids) for j in range(windows)]


def _key(df):
    return sorted((r["customer_id"], r["window_start_us"], r["monitoring_level"], r["sudden_drop_detected"], r["previous_bsi"]) for r in df.collect())


@pytest.mark.parametrize("id_type, ids", [("long", [1, 2, 3, 4, 5]), ("string", ["a", "b:1", "7", "ç"])])
def test_replay_equals_batch(spark, id_type, ids):
    tl = spark.createDataFrame(_rows(ids), f"customer_id {id_type}, window_start_us long, bsi_score double")
    out = MS.replay(spark, tl, tempfile.mkdtemp(prefix="dw-stream-"))
    batch = ST.sudden_drop(tl)
    assert _key(out) == _key(batch)
    assert any(r["sudden_drop_detected"] for r in out.collect())


def test_files_in_any_order_with_a_short_watermark(spark):
    """Files that come up to nine days late; each is a run of its own, as after a restart."""
    rows, base = _rows([1, 2, 3], 20), tempfile.mkdtemp(prefix="dw-stream-")
    rng = random.Random(3)
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 9 * US_DAY))
    schema = "customer_id long, window_start_us long, bsi_score double"
    seen = []
    for i in range(0, len(order), 15):
        MS.write_scored_windows(spark.createDataFrame(order[i:i + 15], schema), f"{base}/in", files=1)
        out = MS.run_to_completion(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", "10 days")
        seen.append(out.count())
    assert seen[0] < seen[-1] < len(rows)  # windows leave as the watermark passes, the last ones wait
    MS.heartbeat(spark, f"{base}/in", START + 100 * US_DAY)
    out = MS.run_to_completion(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", "10 days")
    assert _key(out) == _key(ST.sudden_drop(spark.createDataFrame(rows, schema)))


def test_replayed_files_and_state_that_expires(spark):
    base, schema = tempfile.mkdtemp(prefix="dw-stream-"), "customer_id long, window_start_us long, bsi_score double"
    first = [(1, START, 90.0), (1, START + 3 * US_DAY, 80.0)]

    def run(rows, beat):
        if rows:
            MS.write_scored_windows(spark.createDataFrame(rows, schema), f"{base}/in", files=1)
        MS.heartbeat(spark, f"{base}/in", START + beat * US_DAY)
        return _key(MS.run_to_completion(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", "1 day", keep_days=30))
    assert len(run(first, 6)) == 2
    assert len(run([(1, START + 3 * US_DAY, 10.0)], 7)) == 2  # the same window again is late: dropped
    assert run([(1, START + 9 * US_DAY, 50.0)], 12)[-1] == (1, START + 9 * US_DAY, "immediate", True, 80.0)
    assert len(run([], 60)) == 3  # 30 days behind the last window the state goes
    assert run([(1, START + 61 * US_DAY, 10.0)], 65)[-1] == (1, START + 61 * US_DAY, "immediate", False, None)


def test_empty_history(spark):
    tl = spark.createDataFrame([], "customer_id long, window_start_us long, bsi_score double")
    assert MS.replay(spark, tl, tempfile.mkdtemp(prefix="dw-stream-")).count() == 0

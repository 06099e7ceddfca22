"""Sudden-drop monitoring on a stream of scored windows, in event time.

Scored timeline windows arrive as Parquet files, in any order. The stream is keyed by
customer. A window waits in its customer's state until the watermark has passed its
start: from then on Spark drops anything older, so no earlier window can still come.
Windows that have waited long enough leave in order of their start, each compared with
the one before it, so a drop of more than 20 points forces the ``immediate`` level
whatever files, micro-batches or order the windows came in. A timer on event time wakes
customers that get no new rows. A state without waiting windows is dropped when the
watermark is ``keep`` past its last one.

Rows without a customer are heartbeats: they only move event time on (``heartbeat``
writes one), which lets a finished history go. A stream's watermark starts at 1970, so
older windows are late from the beginning. The sink is Parquet with its checkpoint in
the shared checkpoint folder, so a restarted query resumes from its committed offsets and state.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwatch.functions import dims

STATE_SCHEMA = "starts array<long>, scores array<double>, last_start long, last_bsi double"
COLUMNS = ["customer_id", "window_start_us", "bsi_score", "previous_bsi",
           "monitoring_level", "sudden_drop_detected", "escalation_triggered"]
KEEP_DAYS = 400


def in_schema(id_type: str = "long") -> str:
    return f"customer_id {id_type}, window_start_us long, bsi_score double, event_time timestamp"


def out_schema(id_type: str = "long") -> str:
    return (f"customer_id {id_type}, window_start_us long, bsi_score double, previous_bsi double, "
            "monitoring_level string, sudden_drop_detected boolean, escalation_triggered boolean")


def _level(score: float, sudden: bool) -> str:
    if score <= dims.BSI_CRITICAL or sudden:
        return "immediate"
    if score <= dims.BSI_HIGH_DRIFT:
        return "intensive"
    if score <= dims.BSI_MODERATE:
        return "enhanced"
    return "standard"


def _update(keep_ms: int) -> Callable:
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Add a micro-batch's windows to those that wait, and let go those the watermark has passed."""
        starts, scores, last_start, last_bsi = state.get if state.exists else ([], [], None, None)
        waiting = dict(zip(map(int, starts), map(float, scores)))
        if not state.hasTimedOut:
            for pdf in batches:
                for start, score in zip(pdf["window_start_us"].tolist(), pdf["bsi_score"].tolist()):
                    if last_start is None or start > last_start:  # a replayed file brings nothing new
                        waiting.setdefault(int(start), float(score))
        if pd.isna(key[0]):
            return
        watermark = state.getCurrentWatermarkMs()
        rows = []
        for start in sorted(waiting):
            if start // 1000 > watermark:
                break
            score = waiting.pop(start)
            sudden = last_bsi is not None and last_bsi - score > dims.SUDDEN_DROP_POINTS
            level = _level(score, sudden)
            rows.append((key[0], start, score, last_bsi, level, sudden, level in ("immediate", "intensive") or sudden))
            last_start, last_bsi = start, score
        due = (min(waiting) // 1000 if waiting else last_start // 1000 + keep_ms) + 1 if waiting or last_start is not None else 0
        if waiting or due > watermark:
            left = sorted(waiting)
            state.update((left, [waiting[s] for s in left], last_start, last_bsi))
            state.setTimeoutTimestamp(max(due, watermark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=COLUMNS)
    return update


def monitor_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1,
                   watermark: str = "30 days", id_type: str = "long", keep_days: int = KEEP_DAYS) -> DataFrame:
    """Streaming DataFrame of monitoring decisions from scored-window files. ``watermark``
    is how far behind the newest window another one may arrive; older ones are dropped."""
    s = (spark.readStream.schema(in_schema(id_type)).option("maxFilesPerTrigger", max_files_per_trigger)
         .parquet(source_dir))
    return (s.withWatermark("event_time", watermark)
            .groupBy("customer_id")
            .applyInPandasWithState(_update(keep_days * 86_400_000), out_schema(id_type), STATE_SCHEMA, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def _event_time(us) -> F.Column:
    return F.timestamp_micros(us).alias("event_time")


def write_scored_windows(timeline: DataFrame, path: str, files: int = 4) -> None:
    """Lay scored windows out as ``files`` Parquet files. The monitor orders by event time, so they need no order."""
    (timeline.select("customer_id", "window_start_us", "bsi_score", _event_time("window_start_us"))
     .repartition(files, "window_start_us").write.mode("append").parquet(path))


def heartbeat(spark: SparkSession, path: str, at_us: int, id_type: str = "long") -> None:
    """Add a row without a customer, which moves the stream's event time to ``at_us``."""
    (spark.range(1).select(F.lit(None).cast(id_type).alias("customer_id"), F.lit(at_us).cast("long").alias("window_start_us"),
                           F.lit(None).cast("double").alias("bsi_score"), _event_time(F.lit(at_us).cast("long")))
     .write.mode("append").parquet(path))


def run_to_completion(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, watermark: str = "30 days",
                      id_type: str = "long", keep_days: int = KEEP_DAYS) -> DataFrame:
    """Process every available file (trigger availableNow) and read the sink."""
    q = (monitor_stream(spark, source_dir, 1, watermark, id_type, keep_days).writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out_schema(id_type)).parquet(sink_dir)


def replay(spark: SparkSession, timeline: DataFrame, base: str, files: int = 4) -> DataFrame:
    """A finished history as a stream: its files in no order, then a heartbeat behind the last window.
    The watermark's delay is the history's own length, so nothing in it is late."""
    id_type = timeline.schema["customer_id"].dataType.simpleString()
    write_scored_windows(timeline, f"{base}/in", files)
    first, last = spark.read.parquet(f"{base}/in").agg(F.min("window_start_us"), F.max("window_start_us")).first()
    days = 2 if first is None else (last - first) // 86_400_000_000 + 2
    delay = f"{days} days"
    run_to_completion(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", delay, id_type)
    if last is not None:
        heartbeat(spark, f"{base}/in", last + (days + 1) * 86_400_000_000, id_type)
    return run_to_completion(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", delay, id_type)

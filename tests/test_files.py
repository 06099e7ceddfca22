"""Intermediate files: what nothing reads any more leaves the disk."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from driftwatch.plans.stages import stage
from driftwatch.session import WRITE_CONF, checkpoint_dir, passing, release, stored

SF = "/root/testdata/sf0.001"


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def _paths(spark, name: str) -> list[str]:
    root = checkpoint_dir(spark).removeprefix("file:")
    return [os.path.join(at, f) for at, _, fs in os.walk(os.path.join(root, name)) for f in fs if f.endswith(".parquet")]


def _files(spark, name: str) -> list[str]:
    return [os.path.basename(f) for f in _paths(spark, name)]


def test_shuffle_files_go_with_the_write(spark):
    before, conf = _shuffle_files(spark), {k: spark.conf.get(k, None) for k in WRITE_CONF}
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("c"))
    out = stored(df, "t")
    assert _shuffle_files(spark) <= before
    assert out.count() == 10
    assert {k: spark.conf.get(k, None) for k in WRITE_CONF} == conf


def test_release_and_passing(spark):
    a, b = stored(spark.range(3), "u"), stored(spark.range(4), "u")
    assert len(_files(spark, "u")) >= 2
    release(a)
    release(a, b.select("id"))
    assert b.count() == 4
    with passing(spark):
        inner = stored(spark.range(5), "v")
        with passing(spark):
            stored(spark.range(6), "w")
        assert inner.count() == 5 and not _files(spark, "w")
    assert not _files(spark, "v")


def test_a_stage_keeps_its_own_files_only(spark):
    kept = set(_files(spark, "signals"))
    sf = os.path.join(SF, "")  # read as another folder, so that no stage of another test serves it
    n = E.queries()["b14_all_signals"](spark, SF + "/.").count()
    assert n == E.queries()["b14_all_signals"](spark, sf).count() > 0
    assert set(_files(spark, "signals")) <= kept
    assert stage(spark, SF + "/.", "behavioural", lambda: None).count() == n


def test_rounds_leave_one_state(spark):
    from driftwatch.operators.graph.centrality import hits
    root = checkpoint_dir(spark).removeprefix("file:")
    held = lambda: {d for d in os.listdir(root) if d.startswith("rdd-")} | {os.path.dirname(f) for f in _paths(spark, "hits")}
    kept = held()
    edges = spark.createDataFrame([(f"a{i}", f"b{j}", 1.5 if i == j == 0 else 1.0) for i in range(3) for j in range(3)],
                                  "src string, dst string, weight double")
    rows = hits(edges).collect()
    assert sum(r["hub"] for r in rows) == pytest.approx(1)
    assert len(held() - kept) <= 5  # the numbering and its numbers, edges, the last hubs and authorities

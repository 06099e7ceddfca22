"""Spark session helpers.

The library never creates a session behind the caller's back: functions take
the caller's ``SparkSession``.  ``get_session`` is for tests, the bench and the
command line.
"""
from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import SparkSession

UTC_CONF = "spark.sql.session.timeZone"


def get_session(master: str | None = None, app: str = "driftwatch",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("DRIFTWATCH_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(UTC_CONF, "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DRIFTWATCH_DRIVER_MEM", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """All time arithmetic is done on UTC epoch microseconds."""
    if spark.conf.get(UTC_CONF, None) != "UTC":
        spark.conf.set(UTC_CONF, "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session names none and the master is local (tests) is a
    private folder created and registered; on a cluster that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="driftwatch-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: How intermediate files are written. A write's shuffle files go with it, and not only when the driver's JVM
#: happens to collect garbage: at 360 x sf0.1 those of earlier steps would fill the disks.
WRITE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
              "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}


def write_files(df, path: str) -> None:
    """``df`` as Parquet under ``path``, for frames that are read back."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITE_CONF}
    for k, v in WRITE_CONF.items():
        conf.set(k, v)
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


_FOLDERS = weakref.WeakKeyDictionary()  # stored frame -> its folder
_OPEN: list = []  # folders of the stored frames made in each open ``passing`` block


def stored(df, name: str):
    """``df`` written as Parquet below the checkpoint folder and read back: later jobs read only the
    columns they need, and a lost executor costs a read. Unlike a checkpoint it keeps true sizes,
    where those estimated for a plan multiply over many rounds and take ever longer to plan with."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"
    write_files(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    if _OPEN:
        _OPEN[-1].append(path)
    return out


def _delete(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*frames) -> None:
    """Deletes the files of ``stored`` frames that nothing reads any more (the frames themselves,
    not ones derived from them); other frames are left alone."""
    for f in frames:
        path = _FOLDERS.pop(f, None) if f is not None else None
        if path:
            _delete(f.sparkSession, path)


@contextmanager
def passing(spark):
    """Frames that are ``stored`` in this block are read in it only: their files go at its end."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``driftwatch`` importable in the Python workers (pandas UDFs,
    stateful streaming functions): zip the package once per application and
    add it with ``addPyFile`` — what ``spark-submit --py-files`` does."""
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="driftwatch-pyfiles-"), "driftwatch.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)

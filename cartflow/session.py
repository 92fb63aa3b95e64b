"""Session settings and the shared scratch folder that cuts long lineages."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "cartflow", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; `conf` keys use `__` where Spark uses a dot."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Item sets are small: let many of them stay in the hash map before a task turns to sorting.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16384")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Input bytes per shuffle partition. The plans shuffle a few narrow columns, so a partition is far smaller than this.
PARTITION_BYTES = 256 * 1024 * 1024


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """The size of files or folders, from their listing."""
    total = 0
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += fs.getContentSummary(target).getLength()
    return total


def partitions_for(spark: SparkSession, *paths: str) -> int:
    """Shuffle partitions that fit the input, at least as many as the session has."""
    wanted = math.ceil(input_bytes(spark, *paths) / PARTITION_BYTES)
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def sized_shuffles(spark: SparkSession, *paths: str):
    """Run the jobs inside with shuffle partitions for these inputs; the session's own number comes back after.

    Adaptive execution merges small partitions but does not split large ones, so the number has to start high.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions_for(spark, *paths)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; it may be a mount that all executors share.

    Only a local session may fall back to a folder of this machine: executors elsewhere could not read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """The part of the scratch folder that belongs to this application."""
    return f"{scratch_dir(spark).rstrip('/')}/cartflow/{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one stored table. All of them go when the application ends."""
    root = scratch_root(spark)
    fs, folder = _folder(spark, root)
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored, once no frame that reads it is needed any more."""
    fs, folder = _folder(spark, scratch_root(spark))
    fs.delete(folder, True)


# Where each stored table that is still in use lies.
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    Later stages restart from these files after an executor loss, and the file sizes give Catalyst real
    statistics, so it broadcasts the result only when it is in fact small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "snappy").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[stored] = path
    return stored


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that `materialize` has stored, once nothing reads them any more, and the shuffle files of ended queries.

    Spark deletes shuffle files when the driver collects the plans that wrote them; with much free memory that can be long after.
    """
    for frame in frames:
        path = _stored.pop(frame, None)
        if path:
            fs, folder = _folder(spark, path)
            fs.delete(folder, True)
    spark.sparkContext._jvm.System.gc()

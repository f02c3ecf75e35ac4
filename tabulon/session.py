"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "4m"  # of values in an Arrow batch, where long texts or packed rows go to Python
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}
_staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # where tables are written


def build_session(app_name: str = "tabulon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` wins over them.

    Shuffle and scan sizes are left to the cluster's own configuration: AQE coalesces
    small shuffle partitions and splits skewed ones.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call-site lookup per expression
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tabulon-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started within cut Arrow batches at ``BATCH_BYTES`` (or where the session already cuts them).

    By default a batch has 10000 rows of any size, and executor and Python worker both hold it whole.
    """
    with _unless_set(spark, _ARROW_BYTES, BATCH_BYTES):
        yield


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs started within delete their shuffle files when they end (or do as the session says).

    By default these files stay until the driver happens to collect the plan as garbage, so that many jobs in a row
    fill the executors' disks. A DataFrame whose action runs within should not run another: its shuffles are made again.
    """
    with _unless_set(spark, _CLEAN_SHUFFLES, "true"):
        yield


@contextmanager
def _unless_set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    if before is None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage: a lost executor costs a re-read, not a re-run of the steps before. The table
    goes when the driver ends, or with ``discard``; the shuffle files of the write go at once.
    """
    path = scratch_path(df.sparkSession, label)
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    files, folder = _file_system(df.sparkSession, path)
    files.deleteOnExit(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables as ``staged`` gave them, which nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if path := _staged.pop(table, None):
            files, folder = _file_system(table.sparkSession, path)
            files.delete(folder, True)
            files.cancelDeleteOnExit(folder)

"""Tables in the folder that driver and executors share: cut lineages, results that several jobs read, written files."""

from __future__ import annotations

import contextlib
import contextvars
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_within: contextvars.ContextVar[str] = contextvars.ContextVar("within", default="")


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)  # with its scheme, for readers other than Spark
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session has one of its own; on a cluster that is an error, as its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file:///tmp/checkpoints/{os.getuid()}-{os.getpid()}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    system, path = _path(spark, found)
    return str(system.makeQualified(path).toString()).rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one; it is deleted when the application ends."""
    uri = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    system, path = _path(spark, uri)
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return uri


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table or file, in the innermost scratch()."""
    return f"{own_dir(spark)}/{_within.get()}{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors. It stays until the application or the innermost scratch() ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if a count proves that it has at most max_rows rows, else df, which then joins by a shuffle. df should be staged: it is counted. At most max_rows rows of a few fixed-width columns are ever broadcast."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at its end: what is still needed must be written elsewhere before."""
    own = f"{_within.get()}{uuid.uuid4().hex}/"
    token = _within.set(own)
    try:
        yield
    finally:
        _within.reset(token)
        system, path = _path(spark, f"{own_dir(spark)}/{own.rstrip('/')}")
        system.delete(path, True)

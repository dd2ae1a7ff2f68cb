"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to drop an execution's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound for the bytes of a batch of rows that goes to Python, and ours for staged steps: long rows make smaller batches.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_written: list[str] = []
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without one, a folder of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="echofold-")
        sc.setCheckpointDir(found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    _delete(path, spark.sparkContext._jsc.hadoopConfiguration())


def _delete(path: str, configuration) -> None:
    at = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(configuration).delete(at, True)


def _forget() -> None:
    """What is left goes when the program ends, also after the session was stopped."""
    if SparkContext._jvm is None:
        return
    spark = SparkSession.getActiveSession()
    configuration = spark.sparkContext._jsc.hadoopConfiguration() if spark and SparkContext._active_spark_context else SparkContext._jvm.org.apache.hadoop.conf.Configuration()
    while _written:
        _delete(_written.pop(), configuration)


atexit.register(_forget)


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Lost executors then cost the tasks that were running, not the steps before, and what
    several steps read is computed once. The shuffle files of the write go when it has
    ended, the rows by discard() or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    own = {_CLEANUP: "true", _BATCH: BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _written.append(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged rows that no later step reads."""
    for df in staged:
        delete(df.sparkSession, df.staged_at)
        _written.remove(df.staged_at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged within goes at the end, but for what is passed to the function that this gives, which belongs to the scope around."""
    own: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.staged_at)
        return df

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.remove(own)
        for path in own:
            if path in kept and _scopes:
                _scopes[-1].append(path)
            elif path not in kept and path in _written:
                delete(spark, path)
                _written.remove(path)

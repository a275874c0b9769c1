"""Shared work folder and written intermediate tables.

Lineage is cut by writing Parquet under `spark.checkpoint.dir`, the folder every
executor can reach. A written table also has a known size, so the planner's own
broadcast threshold decides between a broadcast and a shuffle join. A table is
deleted by `discard` when its consumer is done, and what is left by `close`.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_closing: set[str] = set()
#: Whether a query's shuffle files are deleted when it ends, or when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="inspectrum-"))
    return context.getCheckpointDir()


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/inspectrum/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table of this application."""
    app = spark.sparkContext.applicationId
    if app not in _closing:
        _closing.add(app)
        atexit.register(_close_quietly, spark, app)
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write `df` once and return a scan of the written table; the shuffle files behind it are deleted.

    `compression` is for tables of much text; the session's own codec otherwise.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffles_deleted(spark):
        df.write.parquet(path, partitionBy=partition_by, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._work_path = path
    return table


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a written table are deleted as soon as it is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that `work_path` named, with all in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote; nothing may read them afterwards."""
    for table in tables:
        path = getattr(table, "_work_path", None)
        if path:
            delete_folder(table.sparkSession, path)


def close(spark: SparkSession) -> None:
    """Delete every table that this application wrote; call it when the results are consumed."""
    delete_folder(spark, application_folder(spark))


def _close_quietly(spark: SparkSession, app: str) -> None:
    """At the end of the process: nothing to do when the session is gone already."""
    if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        close(spark)

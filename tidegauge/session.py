"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(app: str = "tidegauge", master: str | None = None, **extra: str) -> SparkSession:
    """Build or reuse a session. On a cluster, master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, app: str = "tidegauge-local") -> SparkSession:
    """Single-machine session for tests and the bench."""
    spark = get_session(
        app,
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only where it is unset (tests on one machine) is a scratch folder created.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh table location in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own switch that removes the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def durable(df):
    """Cut lineage with a table written once to the shared folder.

    The result survives lost executors, and its size is known to the optimizer, which
    then broadcasts it only while it is small. Shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = new_table_path(spark, "durable")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make):
    """The DataFrame that ``make()`` returns as a durable table, without the durable tables written on the way to it.

    They are deleted once the result is written, so nothing but the result may be read afterwards. Calls may be nested.
    """
    outer = _written.get()
    token = _written.set(paths := [])
    try:
        out = durable(make())
    finally:
        _written.reset(token)
    *steps, kept = paths
    for path in steps:
        drop_table(out.sparkSession, path)
    if outer is not None:
        outer.append(kept)
    return out


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``durable`` wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

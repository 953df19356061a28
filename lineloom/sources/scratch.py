"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    A session on one machine that has none gets a temporary folder; on a cluster that
    would be a folder that the executors do not see, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lineloom.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lineloom-")
        spark.conf.set("lineloom.shared.dir", folder)
    return folder.rstrip("/")


def home(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/lineloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{home(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy outlives lost executors, unlike cached blocks.  Results are read from such
    tables when they are used, so those stay until ``clear``; a table that only served
    to make another is given to ``discard``.
    """
    path = scratch(df.sparkSession, label)
    # No _SUCCESS file: on a local disk the driver begins a process to set a new file's permissions,
    # which shares the driver's memory for an instant, and a table is read only after it is written.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stash`` that nothing is to read again."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application; results that have not been read are lost."""
    remove(spark, home(spark))

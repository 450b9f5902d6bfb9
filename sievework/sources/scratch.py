"""Folders that the driver and all executors see, for results that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a local session gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    set_here, known = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if not set_here and not known.isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sievework-"))
        known = context._jsc.sc().getCheckpointDir()
    return (set_here or known.get()).rstrip("/")


def fresh_folder(spark: SparkSession, prefix: str) -> str:
    return f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hadoop_path(spark: SparkSession, uri: str):
    """The file system and the path of a URI."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove_folder(spark: SparkSession, uri: str) -> None:
    files, path = hadoop_path(spark, uri)
    files.delete(path, True)

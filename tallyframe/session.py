"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Folder named by the caller, and folders made for local masters, by application.
_NAMED: dict[str, str] = {}
_WRITTEN: list[str] = []


def constant(spark: SparkSession, value: Column):
    """Value of an expression over literals, for file names and messages."""
    return spark.sql("SELECT 1").select(value).first()[0]


def use_folder(spark: SparkSession, folder: str) -> None:
    """Name the folder for written tables where the session sets none."""
    _NAMED[spark.sparkContext.applicationId] = folder


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for written tables and the progress of streams.

    That is the session's ``spark.checkpoint.dir``, else what ``use_folder`` named. Where neither is
    there, a local master gets a fresh local folder; a cluster must have one. The session is not changed.
    """
    context = spark.sparkContext
    folder = context.getConf().get(CHECKPOINT_DIR) or context.getCheckpointDir() or _NAMED.get(context.applicationId)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tallyframe-")
        use_folder(spark, folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back from there.

    For results that are read several times or cost much to compute: readers scan only the columns
    they need, and a lost executor does not repeat the work. ``remove_written`` deletes these tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remember(path)
    return spark.read.schema(df.schema).parquet(path)


def remember(path: str) -> None:
    """Have ``remove_written`` delete this folder too."""
    _WRITTEN.append(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the tables that this process has written with ``written``; no frame that reads them works afterwards."""
    removed = 0
    while _WRITTEN:
        fs, path = file_system(spark, _WRITTEN.pop())
        removed += bool(fs.delete(path, True))
    return removed


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path with its scheme."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(hadoop_path)

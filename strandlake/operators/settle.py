"""Results that several later steps read, written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it, a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="strandlake-")
        context.setCheckpointDir(at)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended
        pass


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: later steps read files, and a lost executor doesn't bring the steps before back."""
    path = fresh_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forgotten(*frames: DataFrame) -> None:
    """Delete what settled() wrote for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_settled_at", None):
            remove(df.sparkSession, path)

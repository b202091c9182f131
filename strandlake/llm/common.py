"""What the operators of this subpackage share: reading tables, stored intermediates, folds and words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; what is between is a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from all learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir() or at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session may have ended
        pass


#: What a Python worker keeps between tasks of one kind, by name: models and tokenizers that cost time to load.
KEPT: dict[str, object] = {}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, in a worker that lets go of what tasks of another kind kept (KEPT), and that gives its free memory back when the
    task ends. Workers live on between stages, beside an executor that then needs the memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        KEPT.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    return stored_at(df, fresh_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(text: str = "text") -> tuple[Column, Column]:
    """What tells rows apart that may share a doc_id or have none: the id, and a hash of the text (null as empty). Rows
    that are equal in both are copies of each other."""
    return F.col("doc_id").alias("k_id"), F.xxhash64(text_of(text)).alias("k_text")


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One label a document; of repeated rows the largest. Rows without id or label are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )

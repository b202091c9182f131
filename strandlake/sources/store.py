"""A store of alignments that is read by region: Parquet, partitioned by contig and by bins of positions, sorted by position.

A scan takes regions as a table. Which bins they touch is a join on the partition columns, by which Spark prunes folders
when the query runs; inside a file, positions are sorted, so bounds of the regions skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import overlaps

BIN = 1 << 23


def write_alignments(alignments: DataFrame, path: str, width: int = BIN, mode: str = "errorifexists") -> None:
    """alignments (rname, pos, ref_len, ...) as a store; a bin goes to one task or more, by ranges of positions."""
    rows = alignments.where("rname IS NOT NULL AND pos IS NOT NULL").withColumn("bin", F.expr(f"pos div {width}"))
    rows = rows.repartitionByRange("rname", "pos").sortWithinPartitions("rname", "bin", "pos")
    rows.write.mode(mode).partitionBy("rname", "bin").parquet(path)


def scan_regions(spark: SparkSession, path: str, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of the store's alignments and the regions (contig, r_from, r_to: half-open, 1-based) that they overlap."""
    store = spark.read.parquet(path)
    # How far before a region an alignment may begin; one row, from the files' own column.
    longest = store.agg(F.coalesce(F.max("ref_len"), F.lit(0)).alias("n")).first()["n"]
    bounds = regions.agg(F.min("r_from").alias("a"), F.max("r_to").alias("b")).first()
    if bounds["a"] is None:
        return store.limit(0).withColumnRenamed("rname", "contig").join(regions, "contig")
    bins = F.explode(F.expr(f"sequence(greatest(r_from - {longest}, 0) div {width}, greatest(r_to - 1, 0) div {width})"))
    touched = regions.select(F.col("contig").alias("rname"), bins.alias("bin")).distinct()
    rows = store.where(F.col("pos").between(bounds["a"] - longest, bounds["b"] - 1)).join(touched, ["rname", "bin"], "left_semi")
    rows = rows.drop("bin").withColumnRenamed("rname", "contig").withColumns({"l_from": F.col("pos").cast("long"), "l_to": (F.col("pos") + F.col("ref_len")).cast("long")})
    return overlaps(rows, regions).drop("l_from", "l_to")

"""The mergeable counts as streams: depth of contigs and signals by window of positions arrive while reads are mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contig_stats import contig_depth


def depth_stream(alignments: DataFrame) -> DataFrame:
    """Running depth of contigs (output mode complete or update)."""
    return contig_depth(alignments)


def signal_stream(signals: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """signals (ts, contig, sig_type, size) counted by window of time, contig and type; rows later than `late` behind the
    newest are left out (output mode append or update)."""
    rows = signals.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "contig", "sig_type")
    return rows.agg(F.count("*").alias("n"), F.sum("size").alias("bases")).select(F.col("w.start").alias("window_start"), "contig", "sig_type", "n", "bases")

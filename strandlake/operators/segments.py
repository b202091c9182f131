"""Signals of split reads: pairs of a read's aligned segments on a contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled

SIGNAL = ("contig", "pos", "size", "sig_type", "read", "flag", "mapq")


def segments(aligned: DataFrame, least_aligned: int = 300, most: int = 20) -> DataFrame:
    """Segments (with ord by position) of reads that have 2 to most of them on the contig, one on the forward strand at
    least, and 2 of least_aligned bases. aligned: rows of `with_cigar`, without secondary ones."""
    read = Window.partitionBy("qname", "rname")
    ordered = read.orderBy("pos", "flag", "refend", "left_clip", "aligned_len", "right_clip", "mapq")
    rows = aligned.select("qname", "rname", "flag", "pos", "mapq", "left_clip", "right_clip", F.col("query_len").alias("aligned_len"), (F.col("pos") + F.col("ref_len")).alias("refend"))
    rows = rows.withColumns({"n": F.count("*").over(read), "forward": F.bool_or(F.col("flag").bitwiseAND(16) == 0).over(read)})
    rows = rows.where(F.col("n").between(2, most) & F.col("forward") & (F.col("aligned_len") >= least_aligned))
    rows = rows.withColumns({"ord": F.row_number().over(ordered), "n": F.count("*").over(read)})
    return rows.where("n >= 2").drop("n", "forward")


def pairs(segs: DataFrame) -> DataFrame:
    """Each pair of segments of a read and contig, l before r. At most 190 of a read. A segment takes those behind it from its
    read's rows, which are sorted once: no join."""
    rest = [c for c in segs.columns if c not in ("qname", "rname")]
    behind = Window.partitionBy("qname", "rname").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    rows = segs.where("qname IS NOT NULL AND rname IS NOT NULL").withColumn("_behind", F.collect_list(F.struct(*rest)).over(behind))
    rows = rows.select("qname", "rname", *[F.col(c).alias(f"l_{c}") for c in rest], F.explode("_behind").alias("_r"))
    return rows.select("qname", "rname", *[f"l_{c}" for c in rest], *[F.col(f"_r.{c}").alias(f"r_{c}") for c in rest])


def pair_signal(min_size: int = 50, max_size: int = 4_000_000) -> Column:
    """struct<sig_type, pos, size> of a pair, null if it shows none."""
    c = F.col
    fits = lambda size: size.between(min_size, max_size)

    def signal(kind: str, pos: Column, size: Column) -> Column:
        return F.struct(F.lit(kind).alias("sig_type"), pos.cast("long").alias("pos"), size.cast("long").alias("size"))

    ref_gap = c("r_pos") - c("l_refend")
    query_gap = c("r_left_clip") - (c("l_left_clip") + c("l_aligned_len"))
    ordered = c("r_refend") - c("l_refend") > -200
    insertion = (F.abs(ref_gap) <= 300) & fits(query_gap - ref_gap)
    deletion = (-query_gap > -200) & (-query_gap < 2000) & fits(ref_gap - query_gap)
    at = F.greatest(F.lit(0), c("l_refend") - F.greatest(F.lit(0), -query_gap))
    same = F.when(ordered & insertion, signal("I-segment", F.least("r_pos", "l_refend"), query_gap - ref_gap)).when(ordered & deletion, signal("D-segment", at, ref_gap - query_gap))

    def inversion(overlap: Column, span: Column, pos: Column) -> tuple[Column, Column]:
        ok = (overlap > -200) & (overlap < 500) & (span >= F.greatest(F.lit(100), overlap)) & (span - overlap > 0) & fits(span - overlap)
        return ok, signal("INV-segment", pos, span - overlap)

    first = inversion(c("r_left_clip") + c("r_aligned_len") - c("l_right_clip"), c("r_refend") - c("l_refend"), c("l_refend"))
    second = inversion(c("r_aligned_len") + c("r_right_clip") - c("l_left_clip"), c("r_pos") - c("l_pos"), c("l_pos"))
    opposite = F.when(first[0], first[1]).when(second[0], second[1])
    return F.when(c("l_flag").bitwiseAND(16) == c("r_flag").bitwiseAND(16), same).otherwise(opposite)


def segment_signals(aligned: DataFrame, min_size: int = 50, max_size: int = 4_000_000) -> DataFrame:
    out = pairs(segments(aligned)).withColumn("s", pair_signal(min_size, max_size)).where("s IS NOT NULL")
    return out.select(
        F.col("rname").alias("contig"), "s.pos", "s.size", "s.sig_type", F.col("qname").alias("read"),
        (F.col("l_flag") + F.col("r_flag")).alias("flag"), F.expr("CAST((l_mapq + r_mapq) div 2 AS INT)").alias("mapq"),
    )


def cigar_signals(aligned: DataFrame) -> DataFrame:
    named = lambda column, kind: F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["pos"].alias("pos"), x["len"].alias("len")))
    both = F.concat(named("insertions", "I-cigar"), named("deletions", "D-cigar"))
    # explode would add a filter on the array's size below, and so make the array twice.
    rows = aligned.select("rname", "qname", "flag", "mapq", F.explode_outer(both).alias("x")).where("x IS NOT NULL")
    return rows.select(F.col("rname").alias("contig"), "x.pos", F.col("x.len").alias("size"), F.col("x.kind").alias("sig_type"), F.col("qname").alias("read"), "flag", "mapq")


def signals(aligned: DataFrame, min_size: int = 50, max_size: int = 4_000_000) -> DataFrame:
    """All signals of alignments (rows of `with_cigar`); secondary ones are left out. The CIGAR is walked once: the rows
    are settled without their strings."""
    rows = aligned.where(F.col("flag").bitwiseAND(256) == 0)
    rows = settled(rows.select("qname", "rname", "flag", "pos", "mapq", "ref_len", "query_len", "left_clip", "right_clip", "insertions", "deletions"))
    return cigar_signals(rows).unionByName(segment_signals(rows, min_size, max_size))

"""Statistics of contig lengths and read sets, depth of coverage, and quality values.

Order statistics run over counts by length, not over contigs: N50 needs one row for each distinct length, in length
ranges whose totals are summed first, so no task sorts all contigs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, out: str, width: int, descending: bool = False) -> DataFrame:
    """rows with out: the sum of value over rows of keys up to and with this one in order of `order` (a long).

    rows has one row for each keys and order. Two steps: ranges of `width` values of order, then rows of a range.
    """
    sign = F.desc if descending else F.asc
    rows = rows.withColumn("_range", F.expr(f"{order} div {width}"))
    sums = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(sign("_range"))) - F.col("_sum")
    sums = sums.select(*keys, "_range", before.alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_range").orderBy(sign(order)))
    return rows.withColumn("_inside", inside).join(sums, [*keys, "_range"]).withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_before", "_inside")


def n50(contigs: DataFrame, by: list[str] | None = None, length: str = "length") -> DataFrame:
    """by, n50: the largest length at which contigs of that length and above hold half of all bases; 0 without bases."""
    keys = by or []
    rows = contigs if keys else contigs.withColumn("_all", F.lit(0))
    own = keys or ["_all"]
    lengths = rows.groupBy(*own, length).agg((F.count("*") * F.col(length)).alias("bases"))
    lengths = running_sum(lengths, own, length, "bases", "upto", 4096, descending=True)
    totals = lengths.groupBy(*own).agg(F.expr("sum(bases) div 2").alias("half"), F.sum("bases").alias("total"))
    reached = F.max(F.when((F.col("upto") >= F.col("half")) & (F.col("total") > 0), F.col(length)))
    return lengths.join(F.broadcast(totals) if not keys else totals, own).groupBy(*own).agg(F.coalesce(reached, F.lit(0)).cast("long").alias("n50")).drop("_all")


def contig_stats(contigs: DataFrame, min_length: int, large_length: int) -> DataFrame:
    """One row. Contigs of at least min_length are valid; `count_large` counts strictly longer ones than large_length,
    `total_large` sums those of at least that length."""
    c = F.col("length")
    when = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("long")
    sums = contigs.agg(
        F.count("*").alias("n_contigs"), when(c >= min_length, 1).alias("n_valid"), when(c > large_length, 1).alias("n_large"),
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total_length"), when(c >= min_length, c).alias("valid_length"), when(c >= large_length, c).alias("large_length"),
        F.coalesce(F.max(c), F.lit(0)).cast("long").alias("longest"),
    )
    second = contigs.orderBy(F.desc("length")).limit(2).agg(F.when(F.count("*") > 1, F.min("length")).otherwise(0).cast("long").alias("second_longest"))
    n50_all, n50_large = n50(contigs), n50(contigs.where(c > large_length)).withColumnRenamed("n50", "n50_large")
    out = sums.join(F.broadcast(second), F.lit(True)).join(F.broadcast(n50_all), F.lit(True), "left").join(F.broadcast(n50_large), F.lit(True), "left")
    return out.fillna(0, ["n50", "n50_large"])


def fastq_stats(reads: DataFrame, sequence: str = "sequence") -> DataFrame:
    return reads.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length(sequence)), F.lit(0)).cast("long").alias("bases"))


def keep_fraction(stats: DataFrame, genome_size: int, target: float) -> DataFrame:
    """Estimated coverage, and the share of reads to keep: target over the estimate if that is less."""
    out = stats.withColumn("coverage", F.col("bases") / F.lit(float(max(1, genome_size))))
    return out.withColumn("fraction", F.when((F.lit(target) != 0) & (F.col("coverage") > target), F.lit(target) / F.col("coverage")).otherwise(1.0))


def hash_sample(rows: DataFrame, key: str, parts: int, keep: int) -> DataFrame:
    """A fixed share of rows by a hash of their key: keep of every `parts`."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return rows.where(number % parts < keep)


def mapped_stats(alignments: DataFrame) -> DataFrame:
    return alignments.agg(
        F.count("*").alias("n_total"), F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("n_mapped"), F.count_if(F.col("flag").bitwiseAND(256) != 0).alias("n_secondary"),
        F.count_if(F.col("flag").bitwiseAND(2048) != 0).alias("n_supplementary"), F.count_if(F.col("flag").bitwiseAND(3844) == 0).alias("n_countable"),
    )


def contig_depth(alignments: DataFrame) -> DataFrame:
    """contig, n_reads and mapped_bp of primary alignments (neither secondary nor supplementary)."""
    primary = alignments.where(F.col("flag").bitwiseAND(256 | 2048) == 0)
    return primary.groupBy(F.col("rname").alias("contig")).agg(F.count("*").alias("n_reads"), F.sum("seq_len").cast("long").alias("mapped_bp"))


def global_coverage(depth: DataFrame, contigs: DataFrame, min_length: int, default: int = 20) -> DataFrame:
    """One row: coverage, at least 1; default where no base is mapped or no contig is long enough."""
    bp = depth.agg(F.coalesce(F.sum("mapped_bp"), F.lit(0)).alias("bp"))
    total = contigs.where(F.col("length") >= min_length).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
    both = bp.join(F.broadcast(total), F.lit(True))
    known = F.greatest(F.expr("CAST(bp div nullif(total, 0) AS BIGINT)"), F.lit(1).cast("long"))
    return both.select(F.when((F.col("bp") > 0) & (F.col("total") > 0), known).otherwise(default).cast("long").alias("coverage"))


def contig_coverage(contigs: DataFrame, depth: DataFrame, coverage: DataFrame) -> DataFrame:
    """name, length, contig_cov, mincount, maxcov: depth of each contig (the global one where it has none, at least 1)."""
    own = contigs.join(depth, contigs["name"] == depth["contig"], "left").join(F.broadcast(coverage), F.lit(True))
    known = F.expr("CAST(mapped_bp div nullif(length, 0) AS BIGINT)")
    own = own.select("name", "length", F.greatest(F.coalesce(known, "coverage"), F.lit(1)).cast("long").alias("contig_cov"))
    return own.withColumns({"mincount": F.expr("greatest(2L, 2 * contig_cov div 5)"), "maxcov": F.expr("greatest(2L, 2 * contig_cov)")})


def min_support(coverage: Column) -> Column:
    return F.greatest(F.floor(coverage / 10), F.lit(1)).cast("long")


def quality_value(errors: Column, bases: Column) -> Column:
    """-10 log10 of the error rate; infinite without errors or bases."""
    rate = F.try_divide(errors.cast("double"), bases.cast("double"))
    return F.when((errors <= 0) | (bases <= 0), F.lit(float("inf"))).otherwise(-10 * F.log10(rate))


def per_mbp(n: Column, bases: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double") * 1_000_000, bases.cast("double")), F.lit(0.0))

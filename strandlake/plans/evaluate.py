"""Whole plans: from alignments or signals to structural errors, from a pileup to base errors, and the summary of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import base_errors, clusters, contig_stats, corrections, reconcile
from ..operators.cigar import with_cigar
from ..operators.segments import signals
from ..operators.settle import settled
from ..sources.sinks import tall


#: Lines of a summary by column.
LABELS = {
    "n_contigs": "Number of contigs", "n_valid": "Number of valid contigs", "n_large": "Number of large contigs", "total_length": "Total length", "valid_length": "Length of valid contigs",
    "large_length": "Length of large contigs", "longest": "Longest contig", "second_longest": "Second longest contig", "n50": "N50", "n50_large": "N50 of large contigs", "n_total": "Alignments", "n_mapped": "Mapped alignments",
    "n_events": "Structural errors", "n_expansion": "Expansions", "n_collapse": "Collapses", "n_switch": "Haplotype switches", "n_inversion": "Inversions", "n_errors": "Base errors",
    "n_substitution": "Substitutions", "n_small_collapse": "Small collapses", "n_small_expansion": "Small expansions", "errors_per_mbp": "Base errors per Mbp", "depth": "Depth",
    "qv_total_length": "QV by total length", "qv_valid_bases": "QV by valid bases",
}


def detect(alignments: DataFrame, large_contigs: DataFrame, config: Config) -> DataFrame:
    """Signals of the alignments on large contigs (name)."""
    rows = alignments.join(large_contigs.select(F.col("name").alias("rname")), "rname", "left_semi")
    return signals(with_cigar(rows, config.min_size, config.max_size), config.min_size, config.max_size)


def structural_errors(found: DataFrame, contigs: DataFrame, reads: DataFrame, coverage: int, config: Config, support: int | None = None) -> DataFrame:
    """Final events of signals. coverage: of the whole assembly, a number as it bounds depth everywhere."""
    support = support or max(1, coverage // 10)
    events = settled(clusters.events(found, contigs, support, 2 * coverage, config.min_size, config.max_size))
    rows = reconcile.reconciled(reconcile.genotyped(events, reads), config.min_size)
    return reconcile.final_events(rows, coverage, config.support_ratio, config.min_size, config.min_final_support)


def small_scale_errors(pileup: DataFrame, limits: DataFrame, config: Config) -> DataFrame:
    """Significant base errors. limits: name, mincount, maxcov of each contig."""
    rows = pileup.join(limits.select(F.col("name").alias("contig"), "mincount", "maxcov"), "contig")
    return base_errors.significant(base_errors.candidates(rows, config.min_depth), config)


def summary(stats: DataFrame, mapped: DataFrame, structural: DataFrame, small: DataFrame, valid: DataFrame, coverage: int) -> DataFrame:
    """ord, metric, value: contig statistics, mapping, structural errors, base errors, depth and both quality values.

    All are small: one row each of stats, mapped (n_total, n_mapped), structural and small, one row a contig of valid."""
    bases = valid.agg(F.coalesce(F.sum("valid_bases"), F.lit(0)).cast("long").alias("valid_bases"))
    both = stats.join(mapped, F.lit(True)).join(structural, F.lit(True)).join(small, F.lit(True)).join(bases, F.lit(True)).withColumn("depth", F.lit(coverage).cast("long"))
    errors = F.col("error_bases") + F.col("n_errors")
    both = both.withColumns({
        "errors_per_mbp": F.round(contig_stats.per_mbp(F.col("n_errors"), F.col("valid_length")), 4),
        "qv_total_length": F.round(contig_stats.quality_value(errors, F.col("valid_length")), 4),
        "qv_valid_bases": F.round(contig_stats.quality_value(errors, F.when(F.col("valid_bases") > 0, F.col("valid_bases")).otherwise(F.col("valid_length"))), 4),
    })
    return tall(both, LABELS)


def correct(contigs: DataFrame, base: DataFrame, structural: DataFrame, config: Config) -> DataFrame:
    """contigs (name, sequence) patched by edits (chrom, start, end, sv_type, size, support) that have enough support."""
    return corrections.corrected(contigs, *(corrections.supported(x, config.min_correction_support) for x in (base, structural)))


@dataclass(frozen=True)
class Evaluation:
    """What an evaluation finds: final structural events, significant base errors, both as edits, and the summary."""

    structural: DataFrame
    small: DataFrame
    summary: DataFrame

    def edits(self) -> tuple[DataFrame, DataFrame]:
        """Base and structural edits (chrom, start, end, sv_type, size, support) that mend the errors."""
        base = self.small.select(F.col("contig").alias("chrom"), "start", "end", F.col("etype").alias("sv_type"), "size", "support")
        return base, corrections.edits_of_events(self.structural)


def evaluate(contigs: DataFrame, alignments: DataFrame, config: Config, pileup: DataFrame | None = None, support: int | None = None) -> Evaluation:
    """The whole evaluation of contigs (name, sequence) by alignments of reads (as read_sam gives them). pileup: columns of
    bases, if they are known; else they are made from the alignments. The depth is a number that all steps use."""
    lengths = contigs.select("name", F.length("sequence").cast("long").alias("length"))
    depth = settled(contig_stats.contig_depth(alignments))
    cover = contig_stats.global_coverage(depth, lengths, config.min_contig_length, config.default_coverage)
    coverage = cover.first()["coverage"]
    large = lengths.where(F.col("length") >= config.min_large_contig_length)
    rows = settled(with_cigar(alignments.where("cigar <> '*'"), config.min_size, config.max_size).select("rname", "pos", "flag", "ref_len"))
    structural = settled(structural_errors(settled(detect(alignments, large, config)), large, rows, coverage, config, support))
    valid_contigs = lengths.where(F.col("length") >= config.min_contig_length)
    limits = settled(contig_stats.contig_coverage(valid_contigs, depth, cover))
    columns = pileup if pileup is not None else base_errors.native_pileup(alignments, contigs, config.min_mapping_quality)
    columns = settled(columns.join(limits.select(F.col("name").alias("contig"), "mincount", "maxcov"), "contig"))
    small = settled(base_errors.significant(base_errors.candidates(columns, config.min_depth), config))
    counts = base_errors.error_counts(small).withColumnsRenamed({"n_collapse": "n_small_collapse", "n_expansion": "n_small_expansion"})
    stats = contig_stats.contig_stats(lengths, config.min_contig_length, config.min_large_contig_length)
    mapped = contig_stats.mapped_stats(alignments).select("n_total", "n_mapped")
    lines = summary(stats, mapped, reconcile.structural_summary(structural), counts, base_errors.valid_bases(columns, config.min_depth), coverage)
    return Evaluation(structural, small, lines)


def evaluate_and_correct(contigs: DataFrame, alignments: DataFrame, config: Config, pileup: DataFrame | None = None, support: int | None = None) -> tuple[Evaluation, DataFrame]:
    """The evaluation, and the contigs mended by what it found."""
    found = evaluate(contigs, alignments, config, pileup, support)
    return found, correct(contigs, *found.edits(), config)

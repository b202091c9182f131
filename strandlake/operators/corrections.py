"""Sequences patched by their errors: whole ones and tables of pieces (see `pieces`).

A sequence's edits count from the last start to the first, so that earlier coordinates stay true; base edits come first,
and structural ones count in what those have made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contig_stats import n50
from .pieces import WIDTH, mended, patched, pieces_of, whole
from .settle import settled

#: Types of evaluated events by the edit that mends them.
EVENT_EDITS = {"Expansion": "INS", "Collapse": "DEL", "Inversion": "INV"}


def supported(edits: DataFrame, least: int = 1) -> DataFrame:
    return edits.where(F.col("support") >= least)


def corrected_pieces(pieces: DataFrame, base: DataFrame, structural: DataFrame, width: int = WIDTH) -> DataFrame:
    """pieces (name, piece, offset, text) after base edits, then structural ones (chrom, start, end, sv_type, size)."""
    return patched(settled(patched(pieces, base, False, width)), structural, True, width)


def corrected(contigs: DataFrame, base: DataFrame, structural: DataFrame, width: int = WIDTH) -> DataFrame:
    """contigs (name, sequence, ...: each name once) after base edits, then structural ones, for contigs that fit into a row.

    Those of one piece are mended whole, with their edits beside them; longer ones piece by piece."""
    long = F.coalesce(F.length("sequence") > width, F.lit(False))
    at, n = contigs.columns.index("sequence"), len(contigs.columns)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, *sides in zip(*(batch.column(k).to_pylist() for k in (at, n, n + 1)), strict=True):
                for edits, of_events in zip(sides, (False, True), strict=True):
                    text = mended(text, [tuple(e.values()) for e in edits], of_events) if text and edits else text
                out.append(text)
            columns = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(n)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:n])

    large = contigs.where(long)
    none = large.isEmpty()
    of_small = lambda df: df if none else df.join(large.select(F.col("name").alias("chrom")), "chrom", "left_anti")
    # Edits are gathered for contigs of one piece only.
    edit = F.struct(*[(F.col(c) if c == "sv_type" else F.col(c).cast("long")).alias(c) for c in ("start", "end", "sv_type", "size")])
    listed = lambda df, name: of_small(df).groupBy(F.col("chrom").alias("name")).agg(F.collect_list(edit).alias(name))
    rows = contigs.where(~long).join(listed(base, "_b"), "name", "left").join(listed(structural, "_s"), "name", "left")
    out = rows.select(*contigs.columns, "_b", "_s").mapInArrow(mend, contigs.schema)
    if none:
        return out
    of_large = lambda df: df.join(large.select(F.col("name").alias("chrom")), "chrom", "left_semi")
    new = whole(corrected_pieces(settled(pieces_of(large.select("name", "sequence"), width)), of_large(base), of_large(structural), width))
    new = large.join(new.withColumnRenamed("sequence", "_new"), "name", "left").withColumn("sequence", F.coalesce("_new", F.lit(""))).select(*contigs.columns)
    return out.unionByName(new)


def edits_of_events(final: DataFrame) -> DataFrame:
    """Edits that mend final events: one for each start of an event."""
    kind = F.create_map(*[F.lit(x) for pair in EVENT_EDITS.items() for x in pair])
    rows = final.where(F.col("etype").isin(*EVENT_EDITS))
    rows = rows.select(F.col("contig").alias("chrom"), F.explode(F.arrays_zip(F.col("starts"), F.col("ends"))).alias("x"), kind[F.col("etype")].alias("sv_type"), F.array_max("sizes").alias("size"), "support")
    return rows.select("chrom", F.col("x.starts").alias("start"), F.col("x.ends").alias("end"), "sv_type", "size", "support")


def corrected_bases(base: DataFrame, structural: DataFrame) -> DataFrame:
    """One row: edits by kind, and the bases that they touch."""
    n = base.agg(F.count("*").alias("n_base"), F.coalesce(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(1))), F.lit(0)).alias("_b"))
    m = structural.agg(F.count("*").alias("n_structural"), F.coalesce(F.sum(F.abs("size")), F.lit(0)).alias("_s"))
    return n.join(F.broadcast(m), F.lit(True)).select("n_base", "n_structural", (F.col("_b") + F.col("_s")).cast("long").alias("corrected_bases"))


def correction_summary(base: DataFrame, structural: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row: edits by kind and in all, and the length, number and N50 of the corrected contigs (name, sequence)."""
    lengths = contigs.select(F.length("sequence").cast("long").alias("length"))
    n = base.agg(F.count("*").alias("n_base")).join(structural.agg(F.count("*").alias("n_structural")), F.lit(True))
    sums = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_length"), F.count("*").alias("n_contigs"))
    out = n.join(sums, F.lit(True)).join(n50(lengths), F.lit(True), "left").fillna(0, ["n50"])
    return out.select("n_base", "n_structural", (F.col("n_base") + F.col("n_structural")).alias("n_edits"), "total_length", "n_contigs", "n50")

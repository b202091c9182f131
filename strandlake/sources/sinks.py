"""Results as text files: FASTA, tables of tab-separated values, and summaries. Paths are folders that Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_record(width: int | None = 80) -> Column:
    """A record of name and sequence, in lines of width characters, or in one line."""
    body = F.col("sequence") if width is None else F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), r"\n$", "")
    return F.concat(F.lit(">"), "name", F.lit("\n"), body)


def write_fasta(contigs: DataFrame, path: str, width: int | None = 80, mode: str = "errorifexists") -> None:
    contigs.orderBy("name").select(fasta_record(width).alias("value")).write.mode(mode).text(path)


def write_fasta_pieces(pieces: DataFrame, path: str, width: int = 80, mode: str = "errorifexists") -> None:
    """Contigs in pieces (name, piece, offset, text; pieces' width is a multiple of `width`), each in one file, in lines."""
    body = F.regexp_replace(F.regexp_replace("text", f"(.{{{width}}})", "$1\n"), r"\n$", "")
    line = F.when(F.col("piece") == 0, F.concat(F.lit(">"), "name", F.lit("\n"), body)).otherwise(body)
    ordered = pieces.repartitionByRange("name").sortWithinPartitions("name", "piece")
    ordered.select(line.alias("value")).write.mode(mode).text(path)


def write_split_fastq(reads: DataFrame, path: str, parts: int, mode: str = "errorifexists") -> None:
    """reads (turn, name, sequence, qual) dealt to `parts` gzip files in turn, each in a folder part=k, in order."""
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), "qual").alias("value")
    dealt = reads.withColumn("part", (F.col("turn") % parts).cast("int")).repartitionById(parts, "part").sortWithinPartitions("part", "turn")
    dealt.select("part", record).write.mode(mode).option("compression", "gzip").partitionBy("part").text(path)


def write_table(rows: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    """Tab-separated values; elements of an array are joined by semicolons."""
    flat = [F.concat_ws(";", F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode(mode).csv(path, sep="\t", header=header, quote="", escape="")


def tall(one_row: DataFrame, names: dict[str, str], first: int = 0) -> DataFrame:
    """ord, metric, value: the columns of one row as lines of a summary."""
    lines = [F.struct(F.lit(first + k).alias("ord"), F.lit(label).alias("metric"), F.col(c).cast("string").alias("value")) for k, (c, label) in enumerate(names.items())]
    return one_row.select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def write_summary(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.orderBy("ord").select(F.concat_ws("\t", "metric", "value").alias("value")).coalesce(1).write.mode(mode).text(path)


def write_valid_contigs(contigs: DataFrame, folder: str, min_length: int, mode: str = "errorifexists") -> None:
    """valid_contig.fa: contigs of at least min_length, a sequence in one line; contig_length_info: the lengths of all."""
    contigs.where(F.length("sequence") >= min_length).select(fasta_record(None).alias("value")).write.mode(mode).text(f"{folder}/valid_contig.fa")
    contigs.select("name", F.length("sequence").cast("long").alias("length")).write.mode(mode).csv(f"{folder}/contig_length_info", sep="\t", quote="", escape="")


#: The columns of a table of structural errors: fixed values of the file format.
STRUCTURAL_HEADER = (
    "#Contig_Name", "Start_Position", "End_Position", "Supporting_Read", "Type", "Size", "Haplotype_Info", "Depth_Left", "Depth_Right", "Depth_Min", "Supporting_Read_name", "Haplotype_Switch_Info",
)


def write_structural_errors(final: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Final events as a table, range-sorted by contig and first start."""
    rows = final.orderBy("contig", F.col("starts")[0], F.col("ends")[0], "etype")
    write_table(rows.toDF(*STRUCTURAL_HEADER), path, mode=mode)

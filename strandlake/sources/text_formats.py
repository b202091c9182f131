"""Text formats of sequences, alignments, pileups and intervals, as DataFrames.

Files are read by Spark's text reader (gzip by suffix; gzip files can't be split), so folders and globs work as paths.
A field that can't be read as its type is null; rows that lack what they need are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pieces import WIDTH, gridded
from ..operators.settle import settled

_BREAK = r"[\t\n\x0B\f\r ]+"


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f"), "value")


def _f(k: int) -> Column:
    return F.get("f", F.lit(k))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (first word of the header), description, sequence, length. Records without a name are left out; a file begins
    with a header."""
    records = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "\r", ""))
    head = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "^>", ""))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), _BREAK, "")
    rows = records.select(head.alias("head"), body.alias("sequence"))
    rows = rows.withColumns({"name": F.regexp_extract("head", r"^(\S+)", 1), "description": F.regexp_extract("head", r"^\S+\s+(.*)$", 1)})
    return rows.where("name <> ''").select("name", "description", "sequence", F.length("sequence").cast("long").alias("length"))


def read_fasta_pieces(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """The contigs of FASTA files as pieces (name, piece, offset, text); each name once. A file is read in Spark's blocks, and what
    a block has of a contig begins where the blocks before it stop: one row a block is shuffled for that. A line is the
    least that a task holds. Contigs without bases have no pieces; what has no name is left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    kinds = {"file": pa.string(), "block": pa.int64(), "record": pa.int64(), "name": pa.string(), "offset": pa.int64(), "text": pa.string()}
    blank = str.maketrans("", "", "\t\n\x0b\f\r ")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        out, held = [], 0
        for (file, block), own in groupby(rows, key=lambda r: r[:2]):
            record, offset, parts, n = 0, 0, [], 0
            for value in (*(r[2] for r in own), None):
                header = value is not None and value.startswith(">")
                if value is not None and not header:
                    parts.append(value.translate(blank))
                    n += len(parts[-1])
                if n and (value is None or header or n >= width):
                    out.append((file, block, record, None, offset, "".join(parts)))
                    held, offset, parts, n = held + n, offset + n, [], 0
                if header:
                    record, offset = record + 1, 0
                    out.append((file, block, record, (value[1:].split() or [""])[0], 0, ""))
                if held > 1 << 20 or len(out) > 10_000:
                    yield as_batch(out)
                    out, held = [], 0
        yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    rows = settled(lines.mapInArrow(cut, "file string, block long, record long, name string, offset long, text string"))
    # A block's number of records that begin in it, and the bases of its last one.
    ends = rows.groupBy("file", "block").agg(F.max("record").alias("n"), F.max_by(F.col("offset") + F.length("text"), F.struct("record", "offset", F.length("text"))).alias("bases"))
    order = Window.partitionBy("file").orderBy("block")
    ends = ends.withColumn("records", F.sum("n").over(order) - F.col("n"))
    of_last = Window.partitionBy("file", F.col("records") + F.col("n")).orderBy("block")
    ends = ends.withColumn("upto", F.sum("bases").over(of_last)).withColumn("carried", F.coalesce(F.lag("upto").over(order), F.lit(0)))
    placed = rows.join(ends.select("file", "block", "records", "carried"), ["file", "block"])
    number = (F.col("records") + F.col("record")).alias("number")
    names = placed.where("name <> ''").select("file", number, "name")
    parts = placed.where("name IS NULL").select("file", number, (F.col("offset") + F.when(F.col("record") == 0, F.col("carried")).otherwise(0)).alias("offset"), "text")
    return gridded(parts.join(names, ["file", "number"]).select("name", "offset", "text"), width)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0 in its file), value, and begin and end: the lines that the block of this one has. Lines are numbered
    within the blocks that Spark reads a file in, and each block begins after all lines of the ones before it: one row a
    block is shuffled and broadcast for that, no text, and lines stay in order."""
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    end = F.sum("n").over(Window.partitionBy("file").orderBy("block"))
    blocks = settled(blocks.select("file", "block", "first", (end - F.col("n")).alias("begin"), end.alias("end")))
    line = (F.col("begin") + F.col("id") - F.col("first")).alias("line")
    return lines.join(F.broadcast(blocks), ["file", "block"]).select("file", line, F.regexp_replace("value", r"\r$", "").alias("value"), "begin", "end")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, line, value) in order, four a record, to records; a batch is held at a time."""
    rest = None
    for batch in batches:
        columns = batch.columns if rest is None else [pa.concat_arrays(x) for x in zip(rest, batch.columns, strict=True)]
        n = len(columns[0]) // 4
        of = lambda c, k: c.take(pa.array(np.arange(k, 4 * n, 4)))  # noqa: B023, E731
        file, line, value = columns
        yield pa.RecordBatch.from_arrays([of(file, 0), of(line, 0), *(of(value, k) for k in (0, 1, 3))], ["file", "line", "head", "sequence", "qual"])
        rest = [pa.concat_arrays([c.slice(4 * n)]) for c in columns]


def read_fastq_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 0 in its file), name, sequence, qual of records of four lines; a quality line may begin with any sign.
    The task that reads a record's lines puts it together; lines are shuffled only of records that the borders of blocks cut."""
    lines = numbered_lines(spark, path)
    record = F.expr("line div 4")
    inside = (record * 4 >= F.col("begin")) & (record * 4 + 4 <= F.col("end"))
    whole = lines.where(inside).select("file", "line", "value").mapInArrow(_records, "file string, line long, head string, sequence string, qual string")
    of = lambda k, name: F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(name)
    cut = lines.where(~inside).groupBy("file", record.alias("record")).agg(of(0, "head"), of(1, "sequence"), of(3, "qual"))
    rows = whole.select("file", record.alias("record"), "head", "sequence", "qual").unionByName(cut)
    return rows.where(F.col("head").startswith("@") & F.col("qual").isNotNull()).select("file", "record", F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), "sequence", "qual")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence, qual of all records."""
    return read_fastq_records(spark, path).select("name", "sequence", "qual")


def read_numbered_fastq(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0, over files in the order of their names), name, sequence, qual. There is a row for each file."""
    rows = settled(read_fastq_records(spark, path))
    files = rows.groupBy("file").agg(F.max("record").alias("last"))
    files = files.select("file", (F.sum(F.col("last") + 1).over(Window.orderBy("file")) - F.col("last") - 1).alias("before"))
    return rows.join(F.broadcast(files), "file").select((F.col("before") + F.col("record")).alias("number"), "name", "sequence", "qual")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos, mapq, cigar, seq, seq_len, nm. Rows need 11 fields and numbers where due."""
    rows = _fields(spark, path).where(~F.col("value").startswith("@") & (F.size("f") >= 11))
    tags = F.filter(F.slice("f", F.lit(12), F.size("f")), lambda x: x.startswith("NM:i:"))
    out = rows.select(
        _f(0).alias("qname"), _f(1).try_cast("int").alias("flag"), _f(2).alias("rname"), _f(3).try_cast("long").alias("pos"), _f(4).try_cast("int").alias("mapq"), _f(5).alias("cigar"),
        _f(9).alias("seq"), F.length(_f(9)).cast("long").alias("seq_len"), F.substring(F.get(tags, F.lit(0)), 6, 20).try_cast("int").alias("nm"),
    )
    return out.where("flag IS NOT NULL AND pos IS NOT NULL AND mapq IS NOT NULL")


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    rows = _fields(spark, path).where(F.size("f") >= 5)
    return rows.select(_f(0).alias("contig"), _f(1).try_cast("long").alias("pos"), _f(2).alias("ref"), _f(3).try_cast("long").alias("depth"), _f(4).alias("bases")).where("depth IS NOT NULL")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, sv_type (default unknown), size (default end - start), support (column 6, else 5, else 1)."""
    rows = _fields(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size("f") >= 3))
    rows = rows.select(_f(0).alias("chrom"), _f(1).try_cast("long").alias("start"), _f(2).try_cast("long").alias("end"), "f").where("start IS NOT NULL AND end IS NOT NULL")
    number = lambda k: _f(k).try_cast("long")
    return rows.select("chrom", "start", "end", F.coalesce(_f(3), F.lit("unknown")).alias("sv_type"), F.coalesce(number(4), F.col("end") - F.col("start")).alias("size"), F.coalesce(number(5), number(4), F.lit(1)).cast("long").alias("support"))


def read_structural_errors(spark: SparkSession, path: str) -> DataFrame:
    """Edits of a table of structural errors as `sinks.write_table` writes it, by its own column order: contig, starts,
    ends, support, type, sizes. Types of events stand for the edits that mend them."""
    from ..operators.corrections import EVENT_EDITS

    rows = _fields(spark, path).where(~F.col("value").startswith("#") & (F.size("f") >= 6) & (_f(0) != "Contig"))
    kind = F.create_map(*[F.lit(x) for pair in EVENT_EDITS.items() for x in pair])
    first = lambda k: F.regexp_extract(_f(k), r"(\d+)", 1).try_cast("long")
    return rows.select(_f(0).alias("chrom"), first(1).alias("start"), first(2).alias("end"), F.coalesce(kind[_f(4)], _f(4)).alias("sv_type"), first(5).alias("size"), first(3).alias("support")).where("start IS NOT NULL AND end IS NOT NULL")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_of(spark: SparkSession, *paths: str) -> str:
    """The first path that exists."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def read_base_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The filtered table of base errors, else the candidates of all contigs."""
    return read_bed(spark, first_of(spark, f"{folder}/small_scale_error.bed", f"{folder}/base_error_workspace/baseerror_*.bed"))


def read_structural_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The table of structural errors, else the merged signals of all contigs: del_merged_* as deletions and ins_merged_* as
    insertions, of one position each, whose third field stands for the support."""
    if exists(spark, f"{folder}/structural_error.bed"):
        return read_structural_errors(spark, f"{folder}/structural_error.bed")
    out = spark.createDataFrame([], "chrom string, start long, end long, sv_type string, size long, support long")
    for prefix, kind in (("del", "DEL"), ("ins", "INS")):
        path = f"{folder}/ae_merge_workspace/{prefix}_merged_*"
        if exists(spark, path):
            pos = F.coalesce(_f(1).try_cast("long"), F.lit(0).cast("long"))
            rows = _fields(spark, path).where((F.trim("value") != "") & (F.size("f") >= 3))
            rows = rows.select(_f(0).alias("chrom"), F.greatest(pos - 1, F.lit(0)).alias("start"), pos.alias("end"), F.lit(kind).alias("sv_type"), F.lit(1).cast("long").alias("size"), F.coalesce(_f(2).try_cast("long"), F.lit(1)).cast("long").alias("support"))
            out = out.unionByName(rows)
    return out


def read_reads(spark: SparkSession, *paths: str) -> DataFrame:
    """All reads of several files, folders or globs; each must match something."""
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)
    out = None
    for path in paths:
        rows = read_fastq(spark, path)
        out = rows if out is None else out.unionByName(rows)
    return out

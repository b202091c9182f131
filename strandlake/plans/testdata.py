"""Domain relations derived from the driver's tables by integer arithmetic, so that other engines can derive the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lineitem row as an aligned segment of the read of its order."""
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "concat('r', l_orderkey) AS qname",
        "CAST(if(l_returnflag = 'R', 16, 0) + if(l_linenumber > 1, 2048, 0) + if(l_suppkey % 10 = 9, 256, 0) AS INT) AS flag",
        "concat('ctg', l_orderkey % 8) AS rname",
        "l_partkey * 100 + 1 + CAST(l_quantity AS BIGINT) % 7 AS pos",
        "CAST(20 + (l_linenumber % 5) * 10 AS INT) AS mapq",
        """concat((l_linenumber % 4) * 450 + CAST(l_quantity AS BIGINT) * 4 + 1, 'S', 300 + (l_partkey % 5) * 40, 'M',
          CASE l_partkey % 4 WHEN 1 THEN concat(50 + (l_partkey % 13) * 5, 'I') WHEN 2 THEN concat(50 + (l_partkey % 13) * 5, 'D') ELSE '' END,
          '250M', CASE WHEN l_partkey % 8 = 5 THEN '30I40M' WHEN l_partkey % 8 = 6 THEN '40D60M' ELSE '' END,
          ((l_linenumber + 2) % 4) * 450 + 200 - CAST(l_quantity AS BIGINT) * 3, 'S') AS cigar""",
    )


def with_seq_len(rows: DataFrame) -> DataFrame:
    """Read length by the CIGAR: what consumes the query, clips included."""
    parts = F.regexp_extract_all("cigar", F.lit(r"(\d+)[SMI=X]"), F.lit(1))
    return rows.withColumn("seq_len", F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))


def alignment_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = _table(spark, sf_dir, "lineitem").agg(((F.max("l_partkey") + 1) * 100 + 5000).alias("length"))
    return length.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "length").select(F.concat(F.lit("ctg"), "k").alias("name"), "length")


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of bases for each part."""
    rows = _table(spark, sf_dir, "lineitem")
    symbol = F.expr(
        """CASE WHEN l_suppkey % 10 >= 8 THEN if(l_linenumber % 2 = 0, '.', ',')
          WHEN l_partkey % 6 = 1 THEN if(l_linenumber % 2 = 0, 'T', 't') WHEN l_partkey % 6 = 2 THEN '.+2AC'
          WHEN l_partkey % 6 = 3 THEN ',-1g' WHEN l_partkey % 6 = 4 THEN '*'
          WHEN l_partkey % 6 = 5 AND l_suppkey % 2 = 0 THEN '^]A' ELSE '.' END"""
    )
    keys = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = rows.groupBy("l_partkey").agg(F.count("*").alias("depth"), F.array_sort(F.collect_list(F.struct(*keys, symbol.alias("sym")))).alias("s"))
    return rows.selectExpr(
        "concat('ctg', l_partkey % 8) AS contig", "l_partkey + 1 AS pos",
        "CASE l_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' ELSE 'N' END AS ref",
        "depth", "array_join(s.sym, '') AS bases",
    )


SIGNAL_CONTIG_LENGTH = 150_000


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an error signal."""
    return _table(spark, sf_dir, "events").selectExpr(
        "concat('ctg', user_id % 4) AS contig",
        "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 20 + 1 AS pos",
        "CAST(floor(value) AS BIGINT) * 40 + 50 AS size",
        "CASE event_type WHEN 'error' THEN 'D-cigar' WHEN 'purchase' THEN 'D-segment' WHEN 'click' THEN 'I-cigar' WHEN 'view' THEN 'I-segment' ELSE 'INV-segment' END AS sig_type",
        "concat('r', event_id % 997) AS read", "CAST((event_id % 2) * 16 AS INT) AS flag", "CAST(20 + event_id % 41 AS INT) AS mapq",
    )


def signal_contigs(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.concat(F.lit("ctg"), "id").alias("name"), F.lit(SIGNAL_CONTIG_LENGTH).cast("long").alias("length"))


def signal_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of 2,000 bases around the signals' contigs, for flanking depth."""
    return _table(spark, sf_dir, "events").selectExpr(
        "concat('ctg', event_id % 4) AS rname", "(event_id * 7919) % 148000 + 1 AS pos",
        "CAST(if(event_id % 11 = 0, 1024, 0) AS INT) AS flag", "CAST(2000 AS BIGINT) AS ref_len",
    )


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("concat('doc', doc_id) AS name", "n_chars AS length", "source")


def edit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(
        "concat('p', p_partkey) AS chrom", "repeat('ACGTTGCA', CAST(4 + p_size % 5 AS INT)) AS sequence",
        "p_partkey % 16 AS start", "p_partkey % 16 + 1 + p_partkey % 4 AS end",
        "CASE p_partkey % 4 WHEN 0 THEN 'SNP' WHEN 1 THEN 'INS' WHEN 2 THEN 'DEL' ELSE 'INV' END AS sv_type",
        "1 + p_partkey % 4 AS size", "1 + p_partkey % 3 AS support",
    )


def edit_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four edits for each part, in stretches of 16 of a sequence of 66."""
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS p", "explode(sequence(0, 3)) AS k").selectExpr(
        "concat('p', p) AS chrom", "concat(repeat('ACGTTGCA', 8), 'AC') AS sequence", "16 * k + p % 8 AS start", "16 * k + p % 8 + 1 + p % 4 AS end",
        "CASE (p + k) % 4 WHEN 0 THEN 'SNP' WHEN 1 THEN 'INS' WHEN 2 THEN 'DEL' ELSE 'INV' END AS sv_type", "1 + p % 4 AS size", "1 + (p + k) % 3 AS support",
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig for each customer."""
    return _table(spark, sf_dir, "customer").selectExpr("concat('k', c_custkey) AS name", "repeat('ACGTTGCAN', CAST(1 + c_custkey % 37 AS INT)) AS sequence")


def reads_with_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 12 bases and their contigs: of every four, one with a mismatch, one with an insertion, one with a deletion."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "concat('s', o_orderkey) AS qname", "CAST(if(o_orderkey % 7 = 0, 1024, 0) AS INT) AS flag", "concat('t', o_custkey % 5) AS rname", "1 + (o_custkey % 30) * 20 AS pos", "60 AS mapq",
        "CASE o_custkey % 4 WHEN 2 THEN '6M2I4M' WHEN 3 THEN '6M1D6M' ELSE '12M' END AS cigar",
        "CASE o_custkey % 4 WHEN 0 THEN 'ACGTACGTACGT' WHEN 1 THEN 'ACGGACGTACGT' WHEN 2 THEN 'ACGTACTTGTAC' ELSE 'ACGTACTACGTA' END AS seq",
    )


def read_contigs(spark: SparkSession) -> DataFrame:
    return spark.range(5).selectExpr("concat('t', id) AS name", "repeat('ACGT', 200) AS sequence")

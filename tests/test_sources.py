"""Text formats: reading, writing, and reading back."""

import gzip
import random

import pytest

from strandlake.sources import sinks, store, text_formats


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first contig\nACGT\n\nAC \n>two\nGG\n>\nTT\n")
    rows = {r.name: r for r in text_formats.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert {k: (r.sequence, r.length, r.description) for k, r in rows.items()} == {"one": ("ACGTAC", 6, "first contig"), "two": ("GG", 2, "")}
    contigs = spark.createDataFrame([("b", "ACGT" * 50), ("a", "AC"), ("c", "A" * 160)], "name string, sequence string")
    sinks.write_fasta(contigs, str(tmp_path / "out"))
    back = text_formats.read_fasta(spark, str(tmp_path / "out")).select("name", "sequence")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in contigs.collect()}
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert max(map(len, lines)) == 80 and lines[0] == ">a" and "" not in lines


@pytest.mark.parametrize("block", ["60b", "1g"])
def test_fasta_in_pieces(spark, tmp_path, block):
    """The same contigs as whole records give, also where a block has no header, only headers, or a part of a line."""
    rng = random.Random(6)
    (tmp_path / "in").mkdir()
    for k in range(3):
        records = []
        for j in range(12):
            lines = ["".join(rng.choices("ACGTn", k=rng.choice((0, 1, 20, 75)))) + rng.choice(("", " ", "\r")) for _ in range(rng.choice((0, 1, 2, 9)))]
            records.append("\n".join([f">f{k}_{j}" + rng.choice(("", " some words", "\tx")), *lines]))
        (tmp_path / "in" / f"{k}.fa").write_text("\n".join([*records, ">", "ACGT", ""]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        found = text_formats.read_fasta_pieces(spark, str(tmp_path / "in"), 48).collect()
        expected = {r.name: r.sequence for r in text_formats.read_fasta(spark, str(tmp_path / "in")).collect() if r.sequence}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.name, r.piece, r.offset, r.text) for r in found} == {(n, k // 48, k, s[k : k + 48]) for n, s in expected.items() for k in range(0, len(s), 48)}
    assert len(found) > len(expected) > 20
    rows = spark.createDataFrame([(n, k // 160, k, s[k : k + 160]) for n, s in expected.items() for k in range(0, len(s), 160)], "name string, piece long, offset long, text string")
    sinks.write_fasta_pieces(rows, str(tmp_path / "out"))
    assert {r.name: r.sequence for r in text_formats.read_fasta(spark, str(tmp_path / "out")).collect()} == expected
    assert max(len(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()) <= 80


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{k} x\nACGTA\n+\n{'@+@@I' if k % 2 else 'IIIII'}\n" for k in range(50))
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # splits within records
    try:
        rows = text_formats.read_fastq(spark, str(tmp_path / "*.fastq*")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.name, r.sequence, r.qual) for r in rows) == sorted((f"r{k}", "ACGTA", "@+@@I" if k % 2 else "IIIII") for k in range(50) for _ in range(2))


def test_sam(spark, tmp_path):
    good = "read1\t0\tchr1\t1000\t20\t100M\t*\t0\t0\tACGT\t****\tAS:i:1\tNM:i:2"
    (tmp_path / "a.sam").write_text("\n".join(["@HD\tVN:1", good, "short\t0\tchr1", good.replace("\t1000\t", "\tx\t"), good.rsplit("\t", 2)[0]]))
    rows = text_formats.read_sam(spark, str(tmp_path / "a.sam")).collect()
    assert [(r.qname, r.flag, r.rname, r.pos, r.mapq, r.cigar, r.seq_len, r.nm) for r in rows] == [("read1", 0, "chr1", 1000, 20, "100M", 4, 2), ("read1", 0, "chr1", 1000, 20, "100M", 4, None)]


def test_bed_and_pileup(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#c\nchr1\t100\t200\tDEL\t100\t5\n\nchr1\t1\t9\nchr1\t1\t9\tINS\t3\nchr1\tx\t9\n")
    rows = text_formats.read_bed(spark, str(tmp_path / "a.bed")).collect()
    assert sorted((r.chrom, r.start, r.end, r.sv_type, r.size, r.support) for r in rows) == [("chr1", 1, 9, "INS", 3, 3), ("chr1", 1, 9, "unknown", 8, 1), ("chr1", 100, 200, "DEL", 100, 5)]
    (tmp_path / "a.pileup").write_text("c\t1\tA\t3\t...\tIII\nc\t2\tA\tx\t.\nc\t3\tA\n")
    assert [(r.pos, r.depth, r.bases) for r in text_formats.read_pileup(spark, str(tmp_path / "a.pileup")).collect()] == [(1, 3, "...")]


def test_structural_table(spark, tmp_path):
    rows = spark.createDataFrame([("c", [5], [9], 17, "Expansion", [4]), ("c", [1, 2], [3, 4], 3, "HaplotypeSwitch", [9, 8])], "contig string, starts array<long>, ends array<long>, support long, etype string, sizes array<long>")
    sinks.write_table(rows, str(tmp_path / "s"), header=False)
    back = text_formats.read_structural_errors(spark, str(tmp_path / "s")).collect()
    assert sorted((r.chrom, r.start, r.end, r.sv_type, r.size, r.support) for r in back) == [("c", 1, 3, "HaplotypeSwitch", 9, 3), ("c", 5, 9, "INS", 4, 17)]
    assert text_formats.first_of(spark, str(tmp_path / "none*"), str(tmp_path / "s")).endswith("s")


def test_summary(spark, tmp_path):
    lines = sinks.tall(spark.createDataFrame([(1, 2.5)], "a long, b double"), {"b": "B", "a": "A"})
    sinks.write_summary(lines, str(tmp_path / "sum"))
    assert "".join(p.read_text() for p in (tmp_path / "sum").glob("part-*")) == "B\t2.5\nA\t1\n"


def test_stream(spark, tmp_path):
    import datetime as dt

    from strandlake.streaming.counters import signal_stream

    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "c", "D-cigar", 10) for m in (0, 10, 70, 300)]
    spark.createDataFrame(rows, "ts timestamp, contig string, sig_type string, size long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, contig string, sig_type string, size long").parquet(str(tmp_path / "in"))
    query = signal_stream(stream).writeStream.format("memory").queryName("counted").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 1, 2]


def test_store_by_region(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"c{k % 4}", rng.randrange(1, 50_000), rng.choice((0, 40, 900)), k) for k in range(600)] + [(None, 5, 5, -1), ("c0", None, 5, -2)]
    store.write_alignments(spark.createDataFrame(rows, "rname string, pos long, ref_len long, k long"), str(tmp_path / "s"), 5000)
    regions = [("c1", 4990, 5010), ("c1", 20_000, 26_000), ("c3", 1, 2), ("c9", 1, 9000), ("c3", 49_000, 60_000)]
    found = store.scan_regions(spark, str(tmp_path / "s"), spark.createDataFrame(regions, "contig string, r_from long, r_to long"), 5000)
    assert sorted((r.k, r.r_from) for r in found.collect()) == sorted((k, a) for c, p, n, k in rows[:-2] for d, a, b in regions if c == d and n and p < b and p + n > a)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "PushedFilters: [IsNotNull(pos)" in plan
    assert store.scan_regions(spark, str(tmp_path / "s"), spark.createDataFrame([], "contig string, r_from long, r_to long"), 5000).count() == 0


def test_split_fastq(spark, tmp_path):
    """Three gzip files of some reads, dealt in turn and in order, over several input files."""
    (tmp_path / "in").mkdir()
    names = [f"r{k:03d}" for k in range(50)]
    for j in range(3):
        (tmp_path / "in" / f"{j}.fastq").write_text("".join(f"@{n} x\n{'ACGT' * (k % 5)}\n+\n{'I' * 4 * (k % 5)}\n" for k, n in list(enumerate(names))[20 * j : 20 * j + 20]))
    reads = text_formats.read_numbered_fastq(spark, str(tmp_path / "in"))
    assert [r["name"] for r in reads.orderBy("number").collect()] == names and {r.number for r in reads.collect()} == set(range(50))
    sinks.write_split_fastq(reads.withColumnRenamed("number", "turn"), str(tmp_path / "out"), 3)
    for k in range(3):
        files = list((tmp_path / "out" / f"part={k}").glob("*.gz"))
        assert len(files) == 1
        lines = gzip.open(files[0], "rt").read().splitlines()
        assert [x[1:] for x in lines[::4]] == names[k::3]


def test_fastq_records_stay_in_their_task(spark, tmp_path):
    """Records are the same however their lines are batched and split, and only those that a border cuts are shuffled."""
    (tmp_path / "a.fastq").write_text("".join(f"@r{k} x\n{'ACGT' * (k % 7)}\n+\n{'@' * 4 * (k % 7)}\n" for k in range(300)) + "@last\nAC\n+\n")
    expected = [(k, f"r{k}", "ACGT" * (k % 7), "@" * 4 * (k % 7)) for k in range(300)]
    keys = {"spark.sql.files.maxPartitionBytes": ("333", "1000000"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("7", "10")}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in range(2):
            for key, values in keys.items():
                spark.conf.set(key, values[k])
            found = text_formats.read_fastq_records(spark, str(tmp_path / "a.fastq"))
            assert sorted((r.record, r.name, r.sequence, r.qual) for r in found.collect()) == expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.index("Union") < plan.index("MapInArrow") < plan.index("Aggregate")

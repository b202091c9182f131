"""Block gzip in splits of any size against the text reader, and clusters of a stream against a plain loop."""

import gzip
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from strandlake.sources import block_gzip, text_formats
from strandlake.streaming.clusters import advance


def reads(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        m = rng.choice((0, 1, 7, 40, 300))
        out.append((f"r{k}", "".join(rng.choices("ACGTN", k=m)), "".join(rng.choices("@+I!", k=m))))
    return out


def text_of(rows, end="\n"):
    return "".join(f"@{n} more{end}{s}{end}+{end}{q}{end}" for n, s, q in rows).encode()


def blocked(text, size):
    """text as blocks of at most `size` bytes of it."""
    return b"".join(block_gzip.compressed(text[k : k + size]) for k in range(0, len(text), size)) + block_gzip.END


@pytest.mark.parametrize(("size", "split", "end"), [(50, 97, "\n"), (333, 400, "\r\n"), (1000, 5000, "\n"), (65_000, 1 << 20, "\n")])
def test_splits_have_each_record_once(tmp_path, size, split, end):
    rows = reads(400, size)
    path = tmp_path / "a.fastq.gz"
    path.write_bytes(blocked(text_of(rows, end), size))
    assert gzip.decompress(path.read_bytes()) == text_of(rows, end)
    reader = block_gzip.BlockGzipReader({"paths": f'[["file://{path}", {path.stat().st_size}]]', "split": str(split)})
    parts = [[r for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] for p in reader.partitions()]
    assert [r for p in parts for r in p] == rows
    assert sum(map(bool, parts)) > 1 or split > path.stat().st_size


def test_same_rows_as_the_text_reader(spark, tmp_path):
    rows = reads(3000, 5)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq.gz").write_bytes(blocked(text_of(rows), 700))
    (tmp_path / "in" / "b.fastq.gz").write_bytes(gzip.compress(text_of(rows[:9])) + gzip.compress(text_of(rows[9:20])))
    (tmp_path / "in" / "c.fastq.gz").write_bytes(block_gzip.END)
    found = block_gzip.read_block_fastq(spark, f"{tmp_path}/in/*.gz", split=10_000)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, text_formats.read_fastq(spark, f"{tmp_path}/in").collect())) == Counter(rows + rows[:20])
    assert found.rdd.getNumPartitions() > 5
    with pytest.raises(FileNotFoundError):
        block_gzip.read_block_fastq(spark, f"{tmp_path}/none/*.gz")


def test_what_is_written_is_read(spark, tmp_path):
    rows = reads(2000, 8)
    df = spark.createDataFrame(rows, "name string, sequence string, qual string")
    assert block_gzip.write_block_fastq(df.repartition(3), f"{tmp_path}/out").agg({"n": "sum"}).first()[0] == len(rows)
    assert Counter(map(tuple, block_gzip.read_block_fastq(spark, f"{tmp_path}/out/*.gz", split=5000).collect())) == Counter(rows)


def test_a_cut_file_fails():
    whole = blocked(text_of(reads(50, 1)), 500)[:-40]
    with pytest.raises((ValueError, zlib.error)):
        list(block_gzip.blocks(pa.BufferReader(whole), 0, len(whole)))


def test_clusters_by_watermarks_are_those_of_a_loop():
    rng = random.Random(4)
    for window in (0, 5, 40):
        rows = [(rng.randrange(500), rng.randrange(9)) for _ in range(200)]
        plain = []
        for p, size in sorted(rows):
            if plain and p <= plain[-1][0] + window:
                plain[-1] = [plain[-1][0], plain[-1][1] + 1, p, plain[-1][3] + size]
            else:
                plain.append([p, 1, p, size])
        found, opened, spots, before = [], [], {}, -1
        for mark in (*range(0, 500, rng.choice((1, 7, 60))), 10_000):
            for p, size in rows:
                if before < p <= mark:
                    n, bases = spots.get(p, (0, 0))
                    spots[p] = (n + 1, bases + size)
            closed, opened = advance(spots, opened, mark, window)
            found, before = found + closed, mark
        assert found == plain and not opened and not spots

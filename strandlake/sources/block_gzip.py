"""FASTQ in block gzip: many small gzip members in a row, so that a file can be read by several tasks.

A split is a range of compressed bytes. It begins at the first block that starts in it: a header whose length leads to
another header or to the end of the file (a block's length is the first field of its header). A record belongs to the
split in which its header line begins, and is read to its end over the split's edge. In a split, a record begins at a
line with @ whose next but one begins with +: no other line of records of letters is followed so, whatever the quality
lines begin with. A file in plain gzip is one split's.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: a block's begin (gzip with a further field) and the field's own begin.
MAGIC, FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
#: The empty block that ends a file: a fixed value of the format.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of text in a block that is written, compressed bytes of a split, and records of a batch.
BLOCK, SPLIT, BATCH = 65_280, 64 << 20, 10_000
HEAD = 18
RECORD = "name string, sequence string, qual string"


def block_size(head: bytes) -> int:
    """The length of the block that begins with these bytes; 0 if none does."""
    if len(head) < HEAD or not head.startswith(MAGIC) or head[12:16] != FIELD:
        return 0
    return struct.unpack("<H", head[16:18])[0] + 1


def compressed(text: bytes) -> bytes:
    """text as blocks."""
    out = []
    for k in range(0, len(text), BLOCK):
        part = text[k : k + BLOCK]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out.append(MAGIC + bytes.fromhex("0000000000ff0600") + FIELD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def first_block(file: pa.NativeFile, start: int, end: int, size: int) -> int | None:
    """Where the first block that begins in [start, end) begins."""
    file.seek(start)
    text = file.read(min(end - start + HEAD, (2 << 16) + HEAD))  # a block has 2^16 bytes at most
    at = text.find(MAGIC)
    while 0 <= at < end - start:
        n = block_size(text[at : at + HEAD])
        if n:
            file.seek(start + at + n)
            if start + at + n == size or block_size(file.read(HEAD)):
                return start + at
        at = text.find(MAGIC, at + 1)
    return None


def blocks(file: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Where each block from one on begins, and its text."""
    file.seek(at)
    while at < size:
        head = file.read(HEAD)
        n = block_size(head)
        if not n:
            raise ValueError(f"no block at byte {at}")
        body = head + file.read(n - HEAD)
        if len(body) < n:
            raise ValueError(f"the file ends inside the block at byte {at}")
        yield at, zlib.decompress(body, 31)
        at += n


def plain(file: pa.NativeFile, size: int) -> Iterator[tuple[int, bytes]]:
    """The text of a file of gzip members of any length."""
    file.seek(0)
    inflate = zlib.decompressobj(31)
    while part := file.read(1 << 20):
        while part:
            yield 0, inflate.decompress(part)
            part = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def lines(texts: Iterator[tuple[int, bytes]], start: int, end: int) -> Iterator[tuple[bool, bytes]]:
    """The lines of a split and those behind it, each with whether it is the split's own: whether it begins behind a line
    break of the split. So a line at the very begin of a split is of the one before, as is the rest of a line."""
    held, own, skip = [], True, start > 0
    for at, text in texts:
        first, *others = text.split(b"\n")
        held.append(first)
        for part in others:
            if not skip:
                yield own, b"".join(held).removesuffix(b"\r")
            held, own, skip = [part], at < end, False
    rest = b"".join(held)
    if rest and not skip:
        yield own, rest.removesuffix(b"\r")


def records(found: Iterator[tuple[bool, bytes]]) -> Iterator[tuple[str, str, str]]:
    """name, sequence and quality of the records whose header line begins in the split."""
    ahead = list(islice(found, 3))
    while len(ahead) == 3 and not (ahead[0][1].startswith(b"@") and ahead[2][1].startswith(b"+")):
        ahead = [*ahead[1:], *islice(found, 1)]
    found = chain(ahead, found)
    while len(four := list(islice(found, 4))) == 4 and four[0][0]:
        head, sequence, _, qual = (x.decode() for _, x in four)
        if head.startswith("@"):
            yield (head[1:].split(maxsplit=1) or [""])[0] if not head[1:2].isspace() else "", sequence, qual


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class BlockGzipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = json.loads(options["paths"]), int(options["split"])

    def partitions(self) -> list[Split]:
        return [Split(p, a, min(a + self.split, n), n) for p, n in self.paths for a in range(0, n, self.split)] or [Split("", 0, 0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        store, at = fs.FileSystem.from_uri(part.path)
        with store.open_input_file(at) as file:
            if block_size(file.read(HEAD)):
                begin = first_block(file, part.start, part.end, part.size)
                texts = iter(()) if begin is None else blocks(file, begin, part.size)
            else:
                texts = plain(file, part.size) if part.start == 0 else iter(())
            rows = records(lines(texts, part.start, part.end))
            while some := list(islice(rows, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*some, strict=True)], ["name", "sequence", "qual"])


class BlockGzip(DataSource):
    """Records of FASTQ files. paths: JSON of pairs of path and length; split: compressed bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "strandlake_block_gzip"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: object) -> BlockGzipReader:
        return BlockGzipReader(self.options)


def _uri(path: str) -> str:
    return re.sub("^file:/+", "file:///", path)


def read_block_fastq(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """name, sequence, qual of all records of the gzip files that paths or globs name, by tasks of about `split` bytes. Each
    path must match a file."""
    files = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if not found:
            raise FileNotFoundError(path)
        files += [(_uri(f.getPath().toString()), f.getLen()) for f in found]
    spark.dataSource.register(BlockGzip)
    return spark.read.format(BlockGzip.name()).option("paths", json.dumps(files)).option("split", str(split)).load()


def write_block_fastq(reads: DataFrame, folder: str) -> DataFrame:
    """reads (name, sequence, qual) as files of block gzip in a folder, one for each task; file and n: what was written.
    A task that is run again writes a file of its own; those that the result doesn't name are to be ignored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(_uri(folder))
        store.create_dir(at, recursive=True)
        name, n, held, size = f"part-{uuid4().hex}.fastq.gz", 0, [], 0
        with store.open_output_stream(f"{at}/{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append("@{}\n{}\n+\n{}\n".format(*row).encode())
                    n, size = n + 1, size + len(held[-1])
                    if size > 1 << 20:
                        text = b"".join(held)
                        whole = len(text) // BLOCK * BLOCK
                        out.write(compressed(text[:whole]))
                        held, size = [text[whole:]], len(text) - whole
            out.write(compressed(b"".join(held)) + END)
        yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    return reads.select("name", "sequence", "qual").mapInArrow(write, "file string, n long")

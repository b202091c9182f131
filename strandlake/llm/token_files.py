"""Token ids in binary shards, with a minimal perfect hash index from document key to place.

Writing: documents are range-partitioned by doc_id (and a hash of the text, so that rows of one id spread too) and sorted;
each partition appends its documents' ids to a shard file (raw little-endian integers, of 2 bytes where all ids of the
tokenizer fit, else 4: see `id_width`) and notes each document's place. The keys are dealt to
buckets by hash, and each bucket's index file holds a minimal perfect hash of its keys: levels of bit arrays in which a
key owns the bit that no other key of the level hits, the bit's rank being the key's slot. Each slot stores a
fingerprint, by which other keys are told apart, and the place: shard, offset, length.

Reading: a key's bucket, slot and place come from its index file in constant time, its ids from one range of a shard.

A key is doc_id and, for repeated rows of an id, their number. Defined results: a null text counts as empty; a null doc_id is
an ordinary key that sorts first; tied ids and repeated rows are keys of their own; a text of any length is encoded whole
(one text and its ids are in memory at a time); further columns, of any name, aren't read; an empty table makes no files.
The window over shards has a row a file.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored, table, text_of
from .tokens import encoder, in_turn

PLACES = "doc_id long, again long, shard int, offset long, n_tokens long"
MAGIC = b"MPHX"


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes: a bijection of unsigned 64-bit integers for each seed."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, missing: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Of (doc_id or null, number); keys of number 0 with an id never collide."""
    own = np.where(missing, np.uint64(0x5851F42D4C957F2D), mixed(doc_id.astype(np.uint64), 1))
    more = mixed(again.astype(np.uint64) * np.uint64(2) + missing.astype(np.uint64), 2)
    return np.where((again == 0) & ~missing, own, mixed(own ^ more, 3))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct hashes. levels: bit arrays as bytes, with the rank before each byte."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits)
            self.ranks.append(before + np.cumsum(counts, dtype=np.int64) - counts)
            before += int(counts.sum())
        self.n = before

    @classmethod
    def build(cls, hashes: np.ndarray, room: float = 2.0) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            size = (int(len(left) * room) + 8) // 8 * 8
            at = (mixed(left, 10 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("two keys have the same hash")
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for some that were never put in."""
        out = np.full(len(hashes), -1, np.int64)
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            todo = np.flatnonzero(out < 0)
            at = (mixed(hashes[todo], 10 + k) % np.uint64(len(bits) * 8)).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[todo[hit]] = ranks[at[hit] >> 3] + below[hit]
        return out


def index_bytes(hashes: np.ndarray, shard: np.ndarray, offset: np.ndarray, n_tokens: np.ndarray) -> bytes:
    """An index file: magic, counts, level sizes, levels, then fingerprints and places by slot."""
    function = PerfectHash.build(hashes)
    slot = function.slots(hashes)
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<QI", len(hashes), len(function.levels)))
    out.write(np.array([len(x) for x in function.levels], "<u8").tobytes())
    for x in function.levels:
        out.write(x.tobytes())
    for values, kind in ((mixed(hashes, 5) >> np.uint64(32), "<u4"), (shard, "<u4"), (offset, "<u8"), (n_tokens, "<u8")):
        column = np.zeros(len(hashes), kind)
        column[slot] = values
        out.write(column.tobytes())
    return out.getvalue()


class Index:
    """An index file as read. find: place of each key's ids, with shard -1 for a key that the index doesn't hold."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not an index file")
        n, n_levels = struct.unpack_from("<QI", data, 4)
        at = 16 + 8 * n_levels
        levels = []
        for size in np.frombuffer(data, "<u8", n_levels, 16):
            levels.append(np.frombuffer(data, np.uint8, int(size), at))
            at += int(size)
        self.function = PerfectHash(levels)
        self.columns = []
        for kind in ("<u4", "<u4", "<u8", "<u8"):
            self.columns.append(np.frombuffer(data, kind, n, at))
            at += n * int(kind[2])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot = self.function.slots(hashes)
        known = slot >= 0
        known[known] = self.columns[0][slot[known]] == (mixed(hashes[known], 5) >> np.uint64(32)).astype(np.uint32)
        at = np.where(known, slot, 0)
        shard, offset, n = (c[at].astype(np.int64) if len(c) else np.zeros(len(at), np.int64) for c in self.columns[1:])
        return np.where(known, shard, -1), offset, n


def put(path: str, data: bytes) -> None:
    """Write a file whole: under a name of this attempt, then moved."""
    store, at = fs.FileSystem.from_uri(path)
    mine = f"{at}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with store.open_output_stream(mine) as out:
        out.write(data)
    moved(store, mine, at)


def moved(store: fs.FileSystem, mine: str, at: str) -> None:
    """Give this attempt's file its name; an earlier attempt's file of that name is replaced (it has the same bytes)."""
    if store.get_file_info(at).type != fs.FileType.NotFound:
        store.delete_file(at)
    store.move(mine, at)


def get(path: str) -> bytes:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def made(spark: SparkSession, folder: str) -> None:
    """Make the folder by Spark's own file system, so that all writers find it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def id_width(tokenizer: str) -> int:
    """Bytes of an id in a shard: 2 where all ids of the tokenizer fit."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab().values()) < 1 << 16 else 4


def _renumbered(places: DataFrame) -> DataFrame:
    """places with the numbers of an id that spans shards going on from shard to shard. Such ids are fewer than shards."""
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    ends = places.groupBy("shard").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = ends.select("last", F.lead("first").over(Window.orderBy("shard")).alias("next"))
    spans = ends.where(F.col("next").isNotNull() & F.col("last").eqNullSafe(F.col("next"))).select(F.col("last.doc_id").alias("_id")).distinct()
    if spans.isEmpty():
        return places
    counts = places.join(F.broadcast(spans), F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("_id", F.col("shard").alias("_shard")).agg(F.count("*").alias("n"))
    before = counts.select("_id", "_shard", (F.sum("n").over(Window.partitionBy("_id").orderBy("_shard")) - F.col("n")).alias("_before"))
    both = places.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("shard") == F.col("_shard")), "left")
    return both.withColumn("again", F.col("again") + F.coalesce("_before", F.lit(0))).select(*places.columns)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, keeps_space: bool = False) -> DataFrame:
    """Write the shards of docs (doc_id, text), once; PLACES of all rows, stored."""
    width = id_width(tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, offset = TaskContext.get().partitionId(), encoder(tokenizer, keeps_space), 0
        store, at = fs.FileSystem.from_uri(f"{folder}/shard-{shard:06d}.ids")
        mine, last, again = f"{at}.{TaskContext.get().taskAttemptId()}", (), 0
        with store.open_output_stream(mine) as out:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for first, texts in in_turn(batch.column(1).to_pylist()):
                    ids, sizes = encode(texts, end_id)
                    if len(ids) and int(ids.max()) >> (8 * width):
                        raise ValueError(f"the end id does not fit in {width} bytes")
                    out.write(ids.astype(f"<u{width}").tobytes())
                    own, numbers = doc_ids[first : first + len(texts)], []
                    for x in own:
                        again = again + 1 if (x,) == last else 0
                        last = (x,)
                        numbers.append(again)
                    offsets = offset + np.cumsum(sizes) - sizes
                    offset += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64()), pa.array(numbers, pa.int64()), pa.array([shard] * len(own), pa.int32()), pa.array(offsets), pa.array(sizes)],
                        [x.split()[0] for x in PLACES.split(", ")],
                    )
        moved(store, mine, at)

    made(docs.sparkSession, folder)
    rows = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return _renumbered(stored(rows.mapInArrow(write, PLACES), "token-places"))


def _hashes(pdf: pd.DataFrame) -> np.ndarray:
    return key_hash(pdf["doc_id"].fillna(0).to_numpy(np.int64), pdf["doc_id"].isna().to_numpy(), pdf["again"].to_numpy(np.int64))


def bucketed(keys: DataFrame, n_buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "again"), F.lit(n_buckets)).cast("int"))


def write_index(places: DataFrame, folder: str, n_buckets: int) -> None:
    """One index file for each bucket."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        data = index_bytes(_hashes(pdf), *(pdf[c].to_numpy() for c in ("shard", "offset", "n_tokens")))
        put(f"{folder}/index-{int(pdf['bucket'].iloc[0]):06d}.mph", data)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "n": [len(pdf)]})

    bucketed(places, n_buckets).groupBy("bucket").applyInPandas(write, "bucket int, n long").agg(F.sum("n")).first()


def find(keys: DataFrame, folder: str, n_buckets: int) -> DataFrame:
    """keys (doc_id, again) with the place that the index gives; shard is -1 for unknown keys."""

    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        index = Index(get(f"{folder}/index-{int(pdf['bucket'].iloc[0]):06d}.mph"))
        shard, offset, n = index.find(_hashes(pdf))
        return pdf[["doc_id", "again"]].assign(shard=shard.astype(np.int32), offset=offset, n_tokens=n)

    return bucketed(keys, n_buckets).groupBy("bucket").applyInPandas(look_up, PLACES)


def ids_at(places: DataFrame, folder: str, width: int) -> DataFrame:
    """places with ids: the ids read from the shards (of `width` bytes each), as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            for k in range(0, len(batch), 256):
                part, ids = batch.slice(k, 256), []
                for shard, offset, n in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "n_tokens")), strict=True):
                    if shard != at:
                        if file:
                            file.close()
                        store, path = fs.FileSystem.from_uri(f"{folder}/shard-{shard:06d}.ids")
                        at, file = shard, store.open_input_file(path)
                    file.seek(offset * width)
                    ids.append(np.frombuffer(file.read(n * width), f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, "ids"])
        if file:
            file.close()

    rows = places.repartition("shard").sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(read, f"{PLACES}, ids binary")


def starts(places: DataFrame) -> DataFrame:
    """shard and the number of ids in the shards before it. There is a row for each file."""
    sums = places.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


def op5_token_files(spark: SparkSession, sf_dir: str, per_bucket: int = 20_000) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    places = write_shards(table(spark, sf_dir, "documents"), folder, tokenizer)
    n_buckets = places.count() // per_bucket + 1
    write_index(places, folder, n_buckets)
    found = find(places.select("doc_id", "again"), folder, n_buckets)
    out = ids_at(found, folder, id_width(tokenizer)).select("doc_id", "again", "shard", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    out = out.join(stored(starts(places), "token-starts"), "shard")
    return out.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "again")


QUERIES = {"op5_token_files": op5_token_files}

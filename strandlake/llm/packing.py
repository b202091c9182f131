"""Hierarchical multi-length packing of token ids.

Context sizes are the powers of two from `least` to `longest`. A document is cut into whole windows of the longest size;
what remains belongs to the smallest tier that holds it. From the longest tier down, the largest remainder opens a
window of its tier; the gap is filled with the largest remainders of shorter tiers that fit, and then with a cut of the
smallest one, whose rest goes back to its tier. So windows are full. The one that is open when a partition ends is cut
into full windows of shorter tiers, and at most `tail` - 1 tokens of a partition stand in a window that is not full.

Windows of a tier are dealt to step groups in slots of `longest` tokens, `slots` to a group, and a slot has windows of
one size: all groups of a partition hold as many tokens but its last one. All happens within the partitions that the
input has, in one pass without a shuffle: a task keeps the remainders of some batches of texts.

Defined results: a null text counts as empty, and an empty text is its end id; repeated rows, tied ids and null ids are
packed row by row; a text of any length is cut into as many windows as it fills (one text and its ids are in memory at a
time); further columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .tokens import encoder, in_turn

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


class Packer:
    """The windows of one partition. out: rows of PIECES that are ready."""

    def __init__(self, part: int, longest: int = 2048, least: int = 256, tail: int = 16, slots: int = 8):
        self.first = part << 40  # ids of partitions don't meet
        self.longest, self.least, self.tail, self.slots = longest, least, tail, slots
        self.pool: list[tuple[int, int, int, tuple]] = []  # (tokens, order, start, document), sorted
        self.tokens = self.order = self.windows = self.n_slots = 0
        self.open: dict[int, tuple[int, int]] = {}  # tier: (slot, windows left in it)
        self.out: list[tuple] = []

    def tier(self, n: int) -> int:
        return max(self.least, 1 << (n - 1).bit_length())

    def _keep(self, n: int, start: int, doc: tuple) -> None:
        if n:
            bisect.insort(self.pool, (n, self.order, start, doc))
            self.order, self.tokens = self.order + 1, self.tokens + n

    def add(self, doc_id, ids: np.ndarray) -> None:
        doc, whole = (doc_id, ids, len(ids)), len(ids) // self.longest * self.longest
        for start in range(0, whole, self.longest):
            self._emit([(self.longest, start, doc)], self.longest)
        self._keep(len(ids) - whole, whole, doc)

    def _take(self, k: int) -> tuple[int, int, tuple]:
        n, _, start, doc = self.pool.pop(k)
        self.tokens -= n
        return n, start, doc

    def _window(self) -> tuple[list, int, int]:
        """Pieces of a window, its size, and the gap that nothing was left to fill."""
        pieces = [self._take(-1)]
        size = self.tier(pieces[0][0])
        gap = size - pieces[0][0]
        while gap and self.pool:
            k = bisect.bisect_left(self.pool, (gap + 1,)) - 1
            n, start, doc = self._take(max(k, 0))
            pieces.append((min(n, gap), start, doc))
            self._keep(n - min(n, gap), start + gap, doc)
            gap -= min(n, gap)
        return pieces, size, gap

    def pack(self, spare: int) -> None:
        """Fill windows while more than `spare` tokens are waiting."""
        while self.tokens > spare:
            pieces, size, gap = self._window()
            if gap:
                self._end(pieces)
            else:
                self._emit(pieces, size)

    def _end(self, pieces: list) -> None:
        """The last pieces of a partition, cut into full windows of falling size."""
        left = sum(p[0] for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            size = size if size >= self.tail else left
            window, gap = [], size
            while gap:
                n, start, doc = pieces[0]
                window.append((min(n, gap), start, doc))
                pieces[0] = (n - min(n, gap), start + min(n, gap), doc)
                gap -= min(n, gap)
                if not pieces[0][0]:
                    pieces.pop(0)
            self._emit(window, size)
            left -= size

    def _emit(self, pieces: list, size: int) -> None:
        tier = size if not size & (size - 1) else self.longest
        slot, left = self.open.get(tier, (0, 0))
        if not left:
            slot, left = self.n_slots, self.longest // tier
            self.n_slots += 1
        self.open[tier] = (slot, left - 1)
        offset = 0
        for n, start, (doc_id, ids, total) in pieces:
            row = ids[start : start + n].astype("<u4").tobytes()
            self.out.append((doc_id, start, n, row, total, self.first + self.windows, offset, tier, self.first + slot // self.slots))
            offset += n
        self.windows += 1

    def ready(self) -> pa.RecordBatch:
        rows = list(zip(*self.out, strict=True)) or [[] for _ in _TYPES]
        self.out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _TYPES, strict=True)], [x.split()[0] for x in PIECES.split(", ")])


def packed(docs: DataFrame, path: str, end_id: int = 1, keeps_space: bool = True, spare: int = 400_000, **options) -> DataFrame:
    """docs (doc_id, text) to PIECES. path: a tokenizer file, where the executors find it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(TaskContext.get().partitionId(), **options), encoder(path, keeps_space)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in in_turn(batch.column(1).to_pylist()):
                ids, sizes = encode(texts, end_id)
                for k, part in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
                    packer.add(doc_ids[first + k], part.copy())
                packer.pack(spare)
                yield packer.ready()
        packer.pack(0)
        yield packer.ready()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(pack, PIECES)


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What op8 and the pipeline's last stage return: pieces with the check sum of their ids."""
    import public_tokenizers

    out = packed(docs, path or public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all docs, as op8 gives them."""
    return pieces(docs)


QUERIES = {"op8_packing": op8_packing}

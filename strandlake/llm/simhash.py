"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint's 64 bits are cut into two segments. Where two fingerprints differ by at most two bits, one of the
segments differs by at most one. Each distinct fingerprint is indexed by both segments, once as they are and once for
each bit with that bit as a wildcard; rows of equal keys meet in one sorted partition, where they are verified on all
bits. A pair with a segment equal meets under the plain key, one with a single differing bit under that bit's.

A group of a key is not expanded to pairs: small ones are compared at once, large ones by one or two wildcards in the
other segment too, where an equal key alone proves the distance; either way a group gives at most one edge a member,
to the least member that it is linked to. A group of over `MOST` fingerprints streams through its task and is not
gathered there: its members meet again under two wildcards anywhere in the 64 bits, at most four to a key. Edges of all
groups are joined to components. Exact copies share a fingerprint and enter as one.

The pipeline's stage looks for near copies, not for near fingerprints: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. By the same method, fingerprints of those sets (of several times 64 bits) are cut into segments
so that of two such sets one segment differs by at most one bit with a chance of `RECALL` at least (see `layout`). A
group of a key gives at most one edge a member, to the first one that it is linked to by near fingerprints; the components
of these edges are clusters, in which all candidates are. Within a cluster, all sets are compared exactly, in tiles, so a
set travels once a tile and not once a pair, and a tile gives at most one edge a member too. Sets of a large cluster that
some pivots join are not compared with each other again.

Defined results: a null or empty text has fingerprint 0 and is linked like any other; a null doc_id belongs to its
component but is never its least id; repeated rows are all returned, and tied ids are told apart by their texts; a text
of any length is read whole (one text and its shingles' hashes are in memory at a time); further columns, of any name,
aren't read, and the stages return them as they are; an empty table gives an empty result. Stages keep rows, not ids: of
each component the row with the least doc_id (nulls last, ties by the text's hash), and of equal rows one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, row_key, stored, table, text_of
from .components import components
from .components import forest as _forest
from .components import joined as _joined

#: Members of a key's group up to which all of them are compared at once, and up to which they are in a task together.
SMALL, MOST = 512, 1 << 16
_PAIR = "a long, b long"


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> list[int]:
    w = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [h(b" ".join(w), seed)] if w else []
    return [h(b" ".join(x), seed) for x in zip(*(w[k:] for k in range(words)), strict=False)]


def fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """A bit is set where over half of a text's shingles have it."""
    each = [shingle_hashes(t, words) for t in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((x for h in each for x in h), np.uint64, int(sizes.sum()))
        starts = (np.cumsum(sizes) - sizes)[full]
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        most = np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > sizes[full, None]
        out[full] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """k_id, k_text (see row_key) and fp: the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, some, size, out = batch.column(2).to_pylist(), [], 0, []
            for t in texts:
                some.append(t)
                size += len(t)
                if size > 1_000_000:
                    out.append(fingerprints(some, words))
                    some, size = [], 0
            out.append(fingerprints(some, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out).view(np.int64))], ["k_id", "k_text", "fp"])

    return docs.select(*row_key(), text_of().cast("binary").alias("text")).mapInArrow(run, "k_id long, k_text long, fp long")


def by_key(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Batches of numbers, sorted by the first, as arrays (column by row): runs of whole keys, or (with True) the next part
    of a key that has over `most` rows. A key's rows may span batches."""
    kept: list[np.ndarray] = []
    large = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if large is not None:
            end = np.searchsorted(rows[0], large, "right")
            if end:
                yield rows[:, :end], True
            rows = rows[:, end:]
        if not rows.shape[1]:
            continue
        large = None
        last = np.searchsorted(rows[0], rows[0, -1])  # the last key's rows wait for the next batch
        if last or (kept and kept[0][0, 0] != rows[0, -1]):
            yield np.concatenate([*kept, rows[:, :last]], axis=1), False
            kept = []
        kept.append(rows[:, last:])
        if sum(x.shape[1] for x in kept) > most:
            large = kept[0][0, 0]
            yield np.concatenate(kept, axis=1), True
            kept = []
    if kept:
        yield np.concatenate(kept, axis=1), False


def _joined_labels(keys: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """labels, where rows of equal keys get the least of theirs."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order].view(np.int64)) != 0]))
    least = np.minimum.reduceat(labels[order], starts)
    out = np.empty_like(labels)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(keys))))
    return out


def linked(fps: np.ndarray, variant: int) -> np.ndarray:
    """For the distinct fingerprints of a key, the place of the first one that each is linked to by any path inside."""
    labels = np.arange(len(fps))
    if len(fps) <= SMALL:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
        while True:
            new = np.where(near, labels[None, :], len(fps)).min(axis=1)
            if (new == labels).all():
                return labels
            labels = new
    segment, bit = divmod(variant, 33)
    other = (fps >> np.uint64(0 if segment else 32)) & np.uint64(0xFFFFFFFF)
    # The rest of the key is equal: with one wildcard in it, one more proves two bits; with none, two more do.
    one = [np.uint64(1 << k) for k in range(32)]
    wild = one if bit < 32 else [x | y for k, x in enumerate(one) for y in one[:k]]
    while True:
        new = labels
        for mask in wild:
            new = _joined_labels(other & ~mask, new)
        if (new == labels).all():
            return labels
        labels = new


def _edges(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both to edges; a member of a key with over `most` rows as (fp, null)."""
    for rows, large in by_key(batches, most):
        keys, fps = rows[0], rows[1].view(np.uint64)
        if large:
            yield pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.nulls(len(keys), pa.int64())], ["a", "b"])
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= 2]
        a, b = [fps[two + 1]], [fps[two]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            own = fps[start : start + size]
            to = linked(own, int(keys[start]) >> 32)
            moved = to != np.arange(size)
            a.append(own[moved])
            b.append(own[to[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def _two_wildcards(fps: DataFrame) -> DataFrame:
    """Edges of fingerprints at most two bits apart: they are equal but for two bits. A key has at most four."""
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
    rows = rows.select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    rest = F.expr("fp & ~(shiftleft(1L, i) | shiftleft(1L, j))").alias("rest")
    four = rows.groupBy("i", "j", rest).agg(F.sort_array(F.collect_set("fp")).alias("x")).where(F.size("x") > 1)
    return four.select(F.explode(F.slice("x", 2, 3)).alias("a"), F.col("x")[0].alias("b"))


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (fp) at most two bits apart."""
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("v"))
    segment = F.expr("shiftrightunsigned(fp, 32 * (v div 33)) & 4294967295L")
    key = F.expr("(CAST(v AS LONG) * 4294967296L) | (segment & CASE WHEN v % 33 = 32 THEN 4294967295L ELSE ~shiftleft(1L, v % 33) END)")
    rows = rows.withColumn("segment", segment).select(key.alias("key"), "fp")
    found = stored(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda b: _edges(b, most), _PAIR), "simhash-edges")
    return found.where("b IS NOT NULL").unionByName(_two_wildcards(found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()))


def grouped(docs: DataFrame, words: int = 3) -> DataFrame:
    """k_id (the doc_id), k_text, fp, root and component_id of all docs. root is any number of the component."""
    fps = stored(with_fingerprint(docs, words), "simhash")
    classes = fps.groupBy("fp").agg(F.min("k_id").alias("least"))
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    by_root = stored(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    ids = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(stored(by_root.join(ids, "root").select("fp", "root", "component_id"), "simhash-ids"), "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents"))
    return out.select(F.col("k_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage's near copies: shingles of so many words, the least similarity, and the least chance that a pair of it meets.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.995
#: Standard deviations above the mean of differing bits up to which a pair is verified on its sets.
DEVIATIONS = 3.5
#: Rows of a key's group that are compared with the group at a time, and rows of a group in a task.
BLOCK, TILE = 1024, 1 << 16
#: Edges of a task that are joined to a forest at a time.
FOREST = 1 << 18
#: Sets of a large cluster that all others are compared with first.
PIVOTS = 16


@dataclass(frozen=True)
class Layout:
    """Of the fingerprints of n sets: the width and number of segments, 64-bit words, and the bits that may differ."""

    width: int
    segments: int
    words: int
    bits: int

    @property
    def variants(self) -> int:
        """Keys of a segment: with each bit as a wildcard, and with none."""
        return self.width + 1


def layout(n: int, least: float = SIMILARITY, recall: float = RECALL) -> Layout:
    """A bit of two sets differs with a chance that follows from their similarity (the angle of their vectors). Segments
    are as wide as keeps the groups of a key from growing with n; their number follows from the width and the recall, so
    a set's keys grow like a power of n (0.24 without wildcards), and not the comparisons of a key."""
    differ = math.acos(2 * least / (1 + least)) / math.pi
    width = max(12, math.ceil(math.log2(max(n, 1))) - 8)
    one = (1 - differ) ** width + width * differ * (1 - differ) ** (width - 1)
    segments = math.ceil(math.log(1 - recall) / math.log(1 - one))
    words = math.ceil(segments / (64 // width))
    return Layout(width, segments, words, math.floor(64 * words * differ + DEVIATIONS * math.sqrt(64 * words * differ * (1 - differ))))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def with_sets(docs: DataFrame, words: int, n_fps: int) -> DataFrame:
    """k_id, k_text, the set's id and n_fps fingerprints (fp0, ...), or with none the set itself."""
    names = ["k_id", "k_text", "id", *([f"fp{k}" for k in range(n_fps)] or ["shingles"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                sets = [shingle_set(t, words) for t in part.column(2).to_pylist()]
                ids = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                rest = [] if n_fps else [pa.array([x.tobytes() for x in sets], pa.binary())]
                again = sets
                for _ in range(n_fps):
                    rest.append(pa.array(_set_fingerprints(again).view(np.int64)))
                    again = [_again(x) for x in again]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids), *rest], names)

    schema = ", ".join(f"{c} {'binary' if c == 'shingles' else 'long'}" for c in names)
    return docs.select(*row_key(), text_of().cast("binary").alias("text")).mapInArrow(lean(run), schema)


def _again(x: np.ndarray) -> np.ndarray:
    """The hashes, hashed once more."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A bit is set where over half of a set's hashes have it."""
    out = np.zeros(len(sets), np.uint64)
    for k, x in enumerate(sets):
        if len(x):
            bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[k] = np.packbits(bits.sum(axis=0, dtype=np.int32) * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


def _near(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (fingerprint by row) that differ by at most `most` bits."""
    x, y = np.nonzero(np.bitwise_count(a[0][:, None] ^ b[0][None, :]) <= min(most, 22))  # of 64 bits, 10 differ at SIMILARITY on average, with a deviation of 3
    bits = sum(np.bitwise_count(p[x] ^ q[y]).astype(np.int32) for p, q in zip(a, b, strict=True))
    good = bits <= most
    return x[good], y[good]


def _near_links(ids: np.ndarray, fps: np.ndarray, most: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that join the rows of a group that near fingerprints join, one a member at most; with side, by pairs of
    unequal sides only."""
    label = np.arange(len(ids))
    for k in range(0, len(ids), BLOCK):
        for j in range(0, k + 1, BLOCK):
            own, other = label[k : k + BLOCK], label[j : j + BLOCK]
            if own.min() == own.max() == other.min() == other.max():
                continue
            x, y = _near(fps[:, k : k + BLOCK], fps[:, j : j + BLOCK], most)
            x, y = x + k, y + j
            good = (y < x) & (label[x] != label[y])
            if side is not None:
                good &= side[x] != side[y]
            if good.any():  # join the labels met so far with those of these pairs
                label = _joined(len(ids), np.concatenate([np.arange(len(ids)), x[good]]), np.concatenate([label, y[good]]))
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _groups(keys: np.ndarray) -> Iterator[slice]:
    """The places of each key that has several rows."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        yield slice(a, b)


def keyed(nodes: DataFrame, form: Layout) -> DataFrame:
    """nodes (id, fp0, ..., further columns) with key: a row for each segment's variant."""
    each, per = form.variants, 64 // form.width
    fps = F.array(*[f"fp{k}" for k in range(form.words)])
    rows = nodes.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(form.segments * each - 1)))).withColumn("fp", F.get(fps, F.expr(f"v div {each} div {per}")))
    segment = F.expr(f"shiftrightunsigned(fp, {form.width} * (v div {each} % {per})) & {(1 << form.width) - 1}L")
    key = F.expr(f"(CAST(v AS LONG) * 4294967296L) | (segment & CASE WHEN v % {each} = {form.width} THEN -1L ELSE ~shiftleft(1L, v % {each}) END)")
    return rows.withColumn("segment", segment).select(key.alias("key"), *nodes.columns)


def near_links(nodes: DataFrame, form: Layout, most: int = TILE) -> DataFrame:
    """Edges (a, b) that join all nodes (id, fp0, ...) that are near and share a key. The rows of a key of over `most` leave
    its task and are dealt to sides, of which any two meet in a task of their own. A node is linked by most of its keys: a
    task gives, of some hundred thousand edges at a time, those from each node to the least that they join it to."""
    names = [f"fp{k}" for k in range(form.words)]

    def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = _forest(found)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, large in by_key(batches, most):
            if large:
                yield pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0])], ["a", "b", "key"])
                continue
            found += [_near_links(rows[1, s], rows[2:, s].view(np.uint64), form.bits) for s in _groups(rows[0])]
            if sum(len(a) for a, _ in found) > FOREST:
                found = [_forest(found)]
                if len(found[0][0]) > FOREST // 2:
                    yield joined(found)
                    found = []
        yield joined(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of several tasks, joined as those of one are: the files of a stage's tasks are read by fewer tasks."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            found.append(tuple(np.asarray(c) for c in batch.columns))
            if sum(len(a) for a, _ in found) > FOREST:
                found = [_forest(found)]
                if len(found[0][0]) > FOREST // 2:
                    yield joined(found).select(["a", "b"])
                    found = []
        yield joined(found).select(["a", "b"])

    def tile(key: tuple, found: pa.Table) -> pa.Table:
        low, high = (x.as_py() for x in key[1:])
        ids, side, *fps = (np.asarray(found.column(c)) for c in ("id", "side", *names))
        a, b = _near_links(ids, np.stack(fps).view(np.uint64), form.bits, None if low == high else side)
        return pa.table({"a": a, "b": b})

    rows = keyed(nodes.select("id", *names), form).repartition("key").sortWithinPartitions("key", "id")
    found = stored(rows.mapInArrow(lean(run), f"{_PAIR}, key long"), "near-links")
    edges = found.where("b IS NOT NULL").select("a", "b").mapInArrow(lean(merged), _PAIR)
    hot = found.where("b IS NULL").select("key", F.col("a").alias("id"))
    dealt = _dealt(hot.withColumn("one", F.lit(False)), "key", F.count("*") / most).join(nodes.select("id", *names), "id")
    return edges.unionByName(dealt.groupBy("key", "low", "high").applyInArrow(tile, _PAIR)).distinct()


def _dealt(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """rows (key, id, one, ...) dealt to sides: a row for each tile, low and high. The rows of a key that are `one` are known
    to be joined and get sides of their own, the first ones; no tile is between two of those. `parts` gives the number of
    sides from all rows of a key that are alike in `one`."""
    n = rows.groupBy(key, "one").agg(F.ceil(parts).cast("int").alias("parts"))
    n = n.groupBy(key).agg(*[F.coalesce(F.max(F.when(c, F.col("parts"))), F.lit(0)).alias(x) for x, c in (("first", F.col("one")), ("others", ~F.col("one")))])
    out = rows.join(n.where("others > 0"), key)
    out = out.withColumn("side", F.expr("CAST(CASE WHEN one THEN pmod(xxhash64(id), first) ELSE first + pmod(xxhash64(id), others) END AS INT)"))
    out = out.withColumn("other", F.explode(F.expr("sequence(CASE WHEN one THEN first ELSE 0 END, first + others - 1)")))
    return out.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("first", "others", "other")


def _similar(sets: list[np.ndarray], side: np.ndarray | None, least: float, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of sets with a Jaccard similarity of at least `least`, counted exactly; with side, of unequal sides.
    The sets from place `first` on are compared with all before them."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else sizes
    full = np.flatnonzero(sizes)
    has, a, b = np.zeros(len(flat) and flat.max() + 1, bool), [], []
    for k in full[full >= first].tolist():
        own = flat[starts[k] : starts[k] + sizes[k]]
        has[own] = True
        rest = full[full < k]
        if len(rest):
            both = np.add.reduceat(has[flat[: starts[k]]], starts[rest], dtype=np.int64)
            good = both >= least * (sizes[k] + sizes[rest] - both)
            if side is not None:
                good &= side[rest] != side[k]
            b.append(rest[good])
            a.append(np.full(len(b[-1]), k))
        has[own] = False
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))


def _to_pivots(large: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of the nodes of each cluster (cluster, id, shingles, parts) to those of its pivots that they are similar
    to. The members of a cluster are dealt to its parts, and each pivot is copied to each part."""

    def star(key: tuple, found: pa.Table) -> pa.Table:
        pivot = np.asarray(found.column("pivot"))
        order = np.argsort(pivot, kind="stable")
        ids, shingles = np.asarray(found.column("id"))[order], found.column("shingles").to_pylist()
        label = _joined(len(ids), *_similar([np.frombuffer(shingles[k], np.uint64) for k in order], None, least, int((~pivot).sum())))
        moved = label != np.arange(len(ids))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    pivots = large.groupBy("cluster", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS)).alias("slot")).agg(F.min("id").alias("id")).select("id")
    members = large.select("cluster", "id", "shingles", F.expr("CAST(pmod(xxhash64(id), parts) AS INT)").alias("side"), F.lit(False).alias("pivot"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("side")
    copies = large.join(pivots, "id", "left_semi").select("cluster", "id", "shingles", each, F.lit(True).alias("pivot"))
    return members.union(copies).groupBy("cluster", "side").applyInArrow(star, _PAIR)


def similar(clusters: DataFrame, least: float, rows: int = 500, size: int = 4_000_000) -> DataFrame:
    """Edges (a, b) that join the nodes of each cluster (cluster, id, shingles) whose sets are similar. A tile has `rows` sets
    or `size` bytes of them a side, more or less.

    In a cluster of more than `rows` sets, all are compared with some pivots first. The largest component of what they join
    needs no comparison within; all other sets are compared with each other and with those of this component. So a group
    of near copies costs its size times the number of sets that are not joined through a pivot, and not its square."""

    def tile(key: tuple, found: pa.Table) -> pa.Table:
        low, high = (x.as_py() for x in key[1:])
        ids, side = np.asarray(found.column("id")), np.asarray(found.column("side"))
        sets = [np.frombuffer(x, np.uint64) for x in found.column("shingles").to_pylist()]
        label = _joined(len(ids), *_similar(sets, None if low == high else side, least))
        moved = label != np.arange(len(ids))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    parts = F.greatest(F.count("*") / rows, F.sum(F.length("shingles")) / size, F.lit(1.0))
    many = clusters.groupBy("cluster").agg(F.ceil(parts).cast("int").alias("parts"), F.count("*").alias("n")).where(f"n > {rows}").drop("n")
    large = clusters.join(many, "cluster")
    stars = stored(_to_pivots(large, least), "near-stars")
    roots = stored(large.select("cluster", "id").join(components(stars, FOREST).withColumnRenamed("node", "id"), "id", "left").select("cluster", "id", F.coalesce("root", "id").alias("root")), "near-roots")
    top = roots.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root"))["root"].alias("root"))
    one = roots.join(top, ["cluster", "root"]).select("id", F.lit(True).alias("one"))
    marked = clusters.join(one, "id", "left").withColumn("one", F.coalesce("one", F.lit(False)))
    return _dealt(marked, "cluster", parts).groupBy("cluster", "low", "high").applyInArrow(tile, _PAIR).union(stars)


def _same_row() -> Column:
    return F.expr("l.k_id <=> r.k_id AND l.k_text = r.k_text")


def similar_groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """k_id, k_text, root: components of the docs whose sets of shingles have a similarity of at least `least`. Equal sets
    are one node."""
    form = layout(docs.count(), least)
    names = [f"fp{k}" for k in range(form.words)]
    rows = stored(with_sets(docs, words, form.words), "near-ids")
    row = F.min(F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_text")).alias("row")
    nodes = stored(rows.groupBy("id").agg(row, *[F.first(c).alias(c) for c in names]), "near-nodes")
    edges = stored(near_links(nodes.select("id", *names), form), "near-edges")
    met = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().join(components(edges, FOREST).withColumnRenamed("node", "id"), "id", "left")
    met = stored(met.select("id", F.coalesce("root", "id").alias("cluster")).join(nodes.select("id", "row"), "id"), "near-met")
    # The sets are made again from the one row of each node that is in a cluster.
    of = docs.select("doc_id", "text", *row_key()).alias("l").join(met.select("row.*").hint("merge").alias("r"), _same_row(), "left_semi")
    sets = with_sets(of, words, 0).dropDuplicates(["id"]).select("id", "shingles").join(met.select("id", "cluster"), "id")
    good = stored(similar(stored(sets, "near-sets"), least), "near-good")
    roots = components(good, FOREST).withColumnRenamed("node", "id")
    return rows.select("k_id", "k_text", "id").join(roots, "id", "left").select("k_id", "k_text", F.coalesce("root", "id").alias("root"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component of found (k_id, k_text, root): see the module's defined results.

    The rows that go, and those with equals, are joined to docs; all others pass."""
    keys = stored(found.groupBy("root", "k_id", "k_text").agg(F.count("*").alias("n")), "near-keys")
    row = F.min(F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_text")).alias("row")
    kept = keys.groupBy("root").agg(row).select("row.k_id", "row.k_text", F.lit(True).alias("stays"))
    marked = keys.alias("l").join(kept.alias("r"), _same_row(), "left").select("l.k_id", "l.k_text", "n", F.coalesce("r.stays", F.lit(False)).alias("stays"))
    marked = stored(marked.where("n > 1 OR NOT stays").select("k_id", "k_text", "stays"), "near-marked")
    rows = docs.select(F.struct("*").alias("row"), *row_key()).alias("l").join(marked.hint("merge").alias("r"), _same_row(), "left").select("row", "l.k_id", "l.k_text", "r.stays")
    several = rows.where("stays").dropDuplicates(["k_id", "k_text"])
    return rows.where("stays IS NULL").select("row.*").unionByName(several.select("row.*"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 3) -> DataFrame:
    """docs with one row of each component of op7: near fingerprints only."""
    return one_of_each(docs, grouped(docs, words).select("k_id", "k_text", "root"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of near copies. Null texts and ids, ties, repeated rows and further columns are
    handled as the module defines; an empty table stays empty."""
    return one_of_each(docs, similar_groups(docs, words, least))


QUERIES = {"op7_simhash": op7_simhash}

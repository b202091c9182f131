"""Embedding near-duplicates by lattice hashing.

Random projections map a unit vector to blocks of eight numbers, and each block to the nearest point of the E8 lattice;
the points of a table's blocks are a vector's cell there. Besides its own cell, a vector also probes the `probes` nearest
neighbouring cells of each table, in which one block moves to an adjacent lattice point. Two vectors are compared where
one's own cell is the other's own or probed cell. Only cells that more than one vector reaches are kept, and a vector's
numbers are read only for those. Cells are smaller the more vectors there are (`settings`), with more tables, so that
the vectors that meet without being near don't grow like the square of the input and the recall stays.

A cell's vectors are compared in tiles of at most `tile` by `tile`, so no task holds a large cell; small cells are compared
many at a time. A linked pair is counted only in the first cell, in order of tables and cells, in which the two meet, and
edges are at most one a vector and tile. Exact copies are one vector with a weight. Links are verified by cosine in double
precision, so none is below the threshold; some may be missed: the recall is that of the hashing.

Defined results: vectors that are null, empty or zero, or hold null or non-finite numbers, and rows with a null label
have no links and are components of their own; a null vec_id takes part but is never a component's least id; repeated rows
and tied ids are linked like any other copies; vectors of unequal lengths are never linked, and a vector of any length is
read whole; further columns, of any name, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components


def _e8_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((len(pairs), 8))
    for k, (i, j, a, b) in enumerate(pairs):
        out[k, i], out[k, j] = a, b
    signs = 0.5 - (np.arange(256)[:, None] >> np.arange(8) & 1)
    return np.concatenate([out, signs[(signs < 0).sum(axis=1) % 2 == 0]])


NEIGHBOURS = _e8_neighbours()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=-1) % 2)
    worst = np.abs(x[odd] - near[odd]).argmax(axis=-1)
    step = np.sign(x[odd, worst] - near[odd, worst])
    near[odd, worst] += np.where(step == 0, 1, step)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points of rows of eight numbers: of D8 or of D8 moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=-1) < ((x - a) ** 2).sum(axis=-1)
    return np.where(closer[:, None], b, a)


#: tables, blocks, probes and scale up to a number of vectors. Random pairs of a cosine of 0.93 meet with a chance of 0.96 or
#: more under each; pairs of 0.5 meet in a table with chances of about 4e-3, 1e-4, 5e-5 and 2e-5.
SETTINGS = ((1 << 16, 8, 3, 6, 0.4), (1 << 20, 16, 3, 6, 0.5), (1 << 24, 20, 4, 12, 0.45), (1 << 63, 24, 5, 16, 0.4))


def settings(n: int) -> dict:
    return next(dict(zip(("tables", "blocks", "probes", "scale"), rest, strict=True)) for most, *rest in SETTINGS if n <= most)


class Lattice:
    """Cells of unit vectors of one length. scale: lattice units of a projected unit."""

    def __init__(self, length: int, tables: int = 8, blocks: int = 3, probes: int = 6, scale: float = 0.4, seed: int = 11):
        rng = np.random.default_rng([seed, length])
        self.tables, self.blocks, self.probes, self.scale = tables, blocks, probes, scale
        self.plane = rng.standard_normal((length, tables * blocks * 8))
        self.odd = rng.integers(0, 2**63, (tables, blocks, 8), np.int64) * 2 + 1
        self.step = (2 * NEIGHBOURS).astype(np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Numbers of the cells: vector by table by (own, then probed)."""
        out = [self._cells(unit[k : k + 512]) for k in range(0, len(unit), 512)]
        return np.concatenate(out) if out else np.zeros((0, self.tables, 1 + self.probes), np.int64)

    def _cells(self, unit: np.ndarray) -> np.ndarray:
        n, t, b = len(unit), self.tables, self.blocks
        x = (self.scale * unit @ self.plane).reshape(-1, 8)
        point = nearest_e8(x)
        with np.errstate(over="ignore"):
            own = ((2 * point).astype(np.int64).reshape(n, t, b, 8) * self.odd).sum(axis=(2, 3)) + np.arange(t) * 0x51ED270B
            # How much farther an adjacent point is, less a constant: the probes are the nearest of all blocks' ones.
            far = -((x - point) @ NEIGHBOURS.T).reshape(n, t, b * len(NEIGHBOURS))
            best = np.argpartition(far, self.probes, axis=2)[:, :, : self.probes]
            moves = np.einsum("kc,tbc->tbk", self.step, self.odd).reshape(t, -1)
            probed = own[:, :, None] + moves[np.arange(t)[None, :, None], best]
        return np.concatenate([own[:, :, None], probed], axis=2)


def usable() -> F.Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of equal length, of norm 1, in double precision."""
    flat = np.asarray(column.flatten(), np.float64)
    v = flat.reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _cells(options: dict):
    """Batches (id, space, length, embedding) to cell (of a space, by its number), id and own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for batch in batches:
            lengths = np.asarray(batch.column(2))
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                lattice = made.setdefault(int(n), Lattice(int(n), **options))
                for k in range(0, len(part), 1024):
                    some = part.slice(k, 1024)
                    cells = lattice.cells(_unit(some.column(3))) ^ np.asarray(some.column(1))[:, None, None]
                    size = cells.shape[1] * cells.shape[2]
                    own = np.tile(np.arange(cells.shape[2]) == 0, len(some) * cells.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(np.asarray(some.column(0)), size)), pa.array(own)], ["cell", "id", "own"])

    return run


def _first_cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of signatures (pair by table by cells) that meet, the least cell of the first table in which they do."""
    out, done = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for k in range(a.shape[1]):
        least = np.full(len(a), np.iinfo(np.int64).max)
        for x, y in ((a, b), (b, a)):
            least = np.minimum(least, np.where(y[:, k] == x[:, k, :1], y[:, k], least[:, None]).min(axis=1))
        met = least < np.iinfo(np.int64).max
        out = np.where(met & ~done, least, out)
        done |= met
    return out


#: Rows of a group up to which its pairs are listed with those of other groups.
FEW = 64


def _listed(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of groups that begin at starts."""
    rows = np.repeat(starts, sizes) + _upto(sizes)
    later = np.repeat(sizes, sizes) - _upto(sizes) - 1
    a = np.repeat(rows, later)
    return a, a + 1 + _upto(later)


def _upto(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of n, in a row."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _compared(options: dict, least: float):
    """Batches sorted by group (a tile of a cell) to counts of links and edges."""
    made: dict[int, Lattice] = {}

    def near_pairs(unit: np.ndarray, own: np.ndarray, ids: np.ndarray, side: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        few = (sizes > 1) & (sizes <= FEW)
        pairs = np.cumsum(sizes[few] * (sizes[few] - 1) // 2)
        for part in np.split(np.flatnonzero(few), np.searchsorted(pairs, np.arange(100_000, pairs[-1] if len(pairs) else 0, 100_000))):
            a, b = _listed(starts[part], sizes[part])
            yield a, b, np.einsum("ij,ij->i", unit[a], unit[b])
        for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
            for k in range(start, start + size, 1024):
                to = np.arange(start, min(k + 1024, start + size))
                cosine = unit[k : k + 1024][: start + size - k] @ unit[to].T
                x, y = np.nonzero(cosine >= least)
                good = k + x > to[y]
                yield k + x[good], to[y[good]], cosine[x[good], y[good]]

    def process(found: pa.Table) -> Iterator[pa.RecordBatch]:
        group, ids, own, side, weight, cell, space = (np.asarray(found.column(c)) for c in ("g", "id", "own", "side", "n", "cell", "space"))
        low, high = np.asarray(found.column("low")), np.asarray(found.column("high"))
        unit = _unit(found.column("embedding").combine_chunks())
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        signs: dict[int, int] = {}
        known = np.zeros((0, 0, 0), np.int64)
        linked_a, linked_b = [label[:0]], [label[:0]]
        for a, b, cosine in near_pairs(unit, own, ids, side, starts, sizes):
            good = (cosine >= least) & (own[a] | own[b]) & (ids[a] != ids[b]) & ((low[a] == high[a]) | (side[a] != side[b]))
            a, b = a[good], b[good]
            if not len(a):
                continue
            linked_a.append(a)
            linked_b.append(b)
            rows = np.unique(np.concatenate([a, b]))
            fresh, at = np.unique(ids[rows], return_index=True)
            new = np.array([x not in signs for x in fresh.tolist()])
            if new.any():  # a vector's cells once, however many of its groups are here
                lattice = made.setdefault(unit.shape[1], Lattice(unit.shape[1], **options))
                more = lattice.cells(unit[rows[at[new]]])
                known = np.concatenate([known, more]) if len(known) else more
                signs.update(zip(fresh[new].tolist(), range(len(signs), len(signs) + int(new.sum())), strict=True))
            place = np.array([signs[x] for x in ids[rows].tolist()])
            for k in range(0, len(a), 50_000):
                p, q = a[k : k + 50_000], b[k : k + 50_000]
                x, y = (known[place[np.searchsorted(rows, z)]] for z in (p, q))
                first = _first_cell(x, y) == cell[p] ^ space[p]
                np.add.at(counts, p[first], weight[q[first]])
                np.add.at(counts, q[first], weight[p[first]])
        a, b = np.concatenate(linked_a), np.concatenate(linked_b)
        while len(a):  # each vector gets the least place of its group that it is linked to by any path
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = (counts > 0) | (label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some]), pa.array(ids[label[some]])], ["id", "links", "to"])

    def by_length(found: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths = np.asarray(found.column("length"))
        for n in np.unique(lengths):
            yield from process(found.filter(pa.array(lengths == n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.asarray(batch.column("g"))
            last = int(np.searchsorted(groups, groups[-1]))  # the last group's rows wait for the next batch
            if last or (kept and kept[0].column("g")[0].as_py() != groups[-1]):
                yield from by_length(pa.Table.from_batches([*kept, batch.slice(0, last)]))
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield from by_length(pa.Table.from_batches(kept))

    return run


def linked(vectors: DataFrame, least: float = 0.93, tile: int = 2048, **options) -> DataFrame:
    """vectors (vec_id, label, embedding) with n_links, component_id and kept. options: of Lattice, else by `settings`."""
    rows = vectors.select("vec_id", "label", "embedding", usable().alias("ok"))
    good = rows.where("ok").select("vec_id", "label", "embedding")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.select("*", F.monotonically_increasing_id().alias("id"), F.xxhash64("label", F.size("embedding")).alias("space")), "embedding-classes")
    options = options or settings(classes.count())
    cells = classes.select("id", "space", F.size("embedding").alias("length"), "embedding").mapInArrow(_cells(options), "cell long, id long, own boolean")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size"), F.max("own").alias("owned")).where("size > 1 AND owned")
    met = cells.join(sizes.select("cell", F.ceil(F.col("size") / tile).cast("int").alias("parts")), "cell")
    met = met.withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("cell", "id", "own", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    met = met.withColumn("g", F.when((F.col("low") == 0) & (F.col("high") == 0), F.col("cell")).otherwise(F.xxhash64("cell", "low", "high")))
    met = met.join(classes.select("id", "n", "space", F.size("embedding").alias("length"), "embedding"), "id")
    found = met.repartition("g").sortWithinPartitions("g").mapInArrow(_compared(options, least), "id long, links long, to long")
    found = stored(found, "embedding-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("id"), "root")
    by_class = classes.select("id", "label", "embedding", "least", "n").join(counts, "id", "left").join(roots, "id", "left")
    by_class = by_class.withColumns({"root": F.coalesce("root", "id"), "n_links": F.coalesce("links", F.lit(0)) + F.col("n") - 1})
    ids = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = by_class.join(ids, "root").select("label", "embedding", "n_links", "component_id")
    out = good.join(by_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


ORACLE_SQL = {
    "op10_lattice": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)"""
}
QUERIES = {"op10_lattice": op10_lattice}

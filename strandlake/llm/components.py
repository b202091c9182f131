"""Connected components of a graph given by its edges, by alternating stars.

Each round is two aggregations and joins on edges; the edges of a round are written to the shared folder, so the lineage
stays short and a lost executor costs one round. The files of the round before last are deleted. A node with very many
edges is dealt to several tasks in each join, so no task reads all edges of a component.

Defined results: repeated edges and loops change nothing; edges with a null end are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, remove, stored_at

#: A node with over a share of 1 / SHARE of all edges (and over FEW) is hot: at most 2 * SHARE nodes are.
SHARE, FEW = 500, 50


def _with_least(rows: DataFrame, n_edges: int) -> DataFrame:
    """rows (u, v) with m: the least of u and all v of its u.

    The rows of a hot u are salted by v, and its least is copied to each salt. Hot nodes are at most 2 * SHARE, as their
    rows sum to twice the edges at most: a table of a proven size, which is broadcast."""
    most = max(FEW, n_edges // SHARE)
    least = rows.groupBy("u").agg(F.min("v").alias("_min"), F.ceil(F.count("*") / most).cast("int").alias("_n"))
    hot = F.broadcast(least.where("_n > 1").select("u", "_n"))
    salt = F.pmod(F.xxhash64("v"), F.coalesce(F.col("_n"), F.lit(1))).cast("int").alias("_salt")
    dealt = rows.join(hot, "u", "left").select("u", "v", salt)
    copies = least.select("u", F.least("u", "_min").alias("m"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_salt"))
    return dealt.join(copies, ["u", "_salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return _with_least(both, n_edges).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every node and its neighbours below are linked to the least of them. Edges go from a down to b."""
    rows = _with_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), n_edges)
    return rows.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(rows.select("u", "m"))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places, the least one that it is linked to by any path of links (a, b)."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def forest(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as all of found: one from each node to the least that it is joined to."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = joined(len(nodes), at[: len(a)], at[len(a) :])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [tuple(np.asarray(c) for c in batch.columns) for batch in batches]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(found)], ["node", "root"])


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """edges (a, b: long, any order, repeats and loops allowed) to (node, root): root is the least node that is linked to
    a node by any path. A node without edges to others, or that is its own root, isn't listed. As soon as no more than `few`
    edges are left, one task joins them."""
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(fresh_path(spark, "components"))
        out = stored_at(df, paths[-1])
        if len(paths) > 2:  # its edges were read for the last time
            remove(spark, paths[-3])
        return out

    down = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = down.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return down.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if now[0] <= few:
            return down.coalesce(1).mapInArrow(_one_forest, "node long, root long")
        before = now
        down = kept(_small_star(_large_star(down, now[0]).distinct(), now[0]).distinct())

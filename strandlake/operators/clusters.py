"""Clusters of signals, merged to events.

Large signals: a greedy cluster starts at a position and takes all that are at most `window` after it. The starts are a
chain over the distinct positions (see `chains`), and the signals join their starts back by position.

Small signals: clusters are the signals of depth regions. Either way a cluster is merged by its sizes and their counts:
order statistics, outliers trimmed, and two events where sizes are bimodal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import with_start, within
from .intervals import depth_regions, depth_segments, overlaps, without_small_twin
from .settle import settled

#: Sizes above are large; of large ones, how far a cluster reaches.
LARGE, WINDOW = 3000, 1600
#: Adaptive clusters: the first window; the window by mean size up to a limit; the window above all limits.
FIRST, ADAPTED, WIDEST = 100, ((100, 200), (500, 400)), 800


def with_cluster(signals: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """signals (keys, pos, ...) with cluster: where it starts; each reaches `window` after its start."""
    spots = signals.select(*keys, "pos").distinct().withColumn("reach", F.lit(window).cast("long"))
    return with_start(signals, spots, keys, window)


def with_adaptive_cluster(signals: DataFrame, keys: list[str], first: int = FIRST) -> DataFrame:
    """signals (keys, pos, size, ...) with cluster. How far a cluster reaches follows from the mean size of its rows at
    most `first` after its start: see ADAPTED."""
    spots = signals.groupBy(*keys, "pos").agg(F.sum("size").cast("long").alias("_sizes"), F.count("*").alias("_rows"))
    spots = within(spots, keys, first, {"_sizes": F.sum("_sizes"), "_rows": F.sum("_rows")})
    mean, reach = F.expr("_sizes div _rows"), F.lit(WIDEST)
    for most, window in reversed(ADAPTED):
        reach = F.when(mean <= most, window).otherwise(reach)
    return with_start(signals, spots.select(*keys, "pos", reach.cast("long").alias("reach")), keys, WIDEST)


class Sizes:
    """Sizes in order, each with how many members have it."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.sizes, self.counts = sizes, counts
        self.upto = np.cumsum(counts)
        self.n = int(self.upto[-1]) if len(counts) else 0

    def group(self, rank: int) -> int:
        """Which size the member of a rank has."""
        return int(np.searchsorted(self.upto, rank, "right"))

    def at(self, rank: int) -> int:
        return int(self.sizes[self.group(rank)])

    def only(self, keep: np.ndarray) -> Sizes:
        return Sizes(self.sizes[keep], self.counts[keep])

    def mean(self, default: int) -> int:
        return int((self.sizes * self.counts).sum()) // self.n if self.n else default

    def trimmed(self, least: int) -> tuple[int, int]:
        """The ranks that stay when far outliers at either end are dropped, one at a time: as the middle moves towards the
        other end, all members of an outlier's size follow it, as far as the limit allows."""
        a, b, limit = 0, self.n, max(least - 2, 2)
        while b - a > limit:
            bottom, middle, top = self.at(a), self.at(a + (b - a) // 2), self.at(b - 1)
            if top > 2 * middle and top - middle > 30:
                k = self.group(b - 1)
                b -= min(b - max(a, int(self.upto[k] - self.counts[k])), b - a - limit)
            elif middle > 2 * bottom and middle - bottom > 30:
                a += min(int(self.upto[self.group(a)]) - a, b - a - limit)
            else:
                break
        return a, b

    def picked(self, support: int) -> tuple[int, int, int, int] | None:
        """The members of one event: the least and the greatest size, how many of the least are dropped (the first ones),
        and how many of the greatest (the last ones). None if there are too few."""
        least = max(2, support)
        a, b = self.trimmed(least)
        if b - a < least:
            return None
        low, high = self.group(a), self.group(b - 1)
        return int(self.sizes[low]), int(self.sizes[high]), a - int(self.upto[low] - self.counts[low]), int(self.upto[high]) - b

    def nearer(self, upper: int, lower: int) -> np.ndarray:
        """Whether each size is nearer to the upper mean, after three rounds from the given means (ties: upper)."""
        near = np.ones(len(self.sizes), bool)
        for _ in range(3):
            near = np.abs(self.sizes - upper) <= np.abs(self.sizes - lower)
            upper, lower = self.only(near).mean(upper), self.only(~near).mean(lower)
        return near

    def events(self, support: int) -> list[tuple[int, int, int, int, str]]:
        """picked() and a tag: one event, two where sizes are bimodal, or none."""
        n = self.n
        if n and n >= 1.5 * support:
            upper, lower = self.at(3 * n // 4), self.at(n // 4)
            if upper > int(1.75 * lower) and upper - lower > 50:
                near = self.nearer(upper, lower)
                found = [x for x in (self.only(side).picked(support) for side in (near, ~near)) if x]
                if found:
                    return [(*x, "CompoundSV" if len(found) == 2 else "Unique") for x in found]
        one = self.picked(support)
        return [(*one, "Unique")] if one else []


def merged(members: DataFrame, keys: list[str], support: int) -> DataFrame:
    """Events of members (contig, pos, size, mapq, read, keys), one or two of each group of keys.

    What an event takes follows from its group's sizes and how many members have each: a row of numbers, however many
    members there are. The members come back by a join on their sizes."""
    rows = settled(members.select(*dict.fromkeys([*keys, "contig", "pos", "size", "mapq", "read"])))
    counts = rows.groupBy(*keys, "size").agg(F.count("*").alias("n"))
    groups = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.array_sort(F.collect_list(F.struct("size", "n"))).alias("_sizes")).where(F.col("_n") >= max(2, support))
    names = ["low", "high", "skip", "drop", "tag"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ends = batch.column(0).values, batch.column(0).offsets.to_numpy()
            sizes, n = (own.field(k).to_numpy().astype(np.int64) for k in ("size", "n"))
            found = [(k, *e) for k in range(batch.num_rows) for e in Sizes(sizes[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]]).events(support)]
            at = pa.array([e[0] for e in found], pa.int64())
            columns = [pa.array([e[1 + k] for e in found], pa.string() if c == "tag" else pa.int64()) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), *columns], [*keys, *names])

    kinds = dict(rows.dtypes)
    picks = groups.select("_sizes", *keys).mapInArrow(pick, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "low long, high long, skip long, drop long, tag string"]))
    taken = settled(rows.join(picks, keys).where(F.col("size").between(F.col("low"), F.col("high"))))
    # Of a size at an edge, the first or the last members in their order may be dropped.
    edge = ((F.col("size") == F.col("low")) & (F.col("skip") > 0)) | ((F.col("size") == F.col("high")) & (F.col("drop") > 0))
    order = Window.partitionBy(*keys, "low", "size").orderBy("pos", "mapq", "read")
    back = Window.partitionBy(*keys, "low", "size").orderBy(F.desc("pos"), F.desc("mapq"), F.desc("read"))
    part = taken.where(edge).withColumns({"_first": F.row_number().over(order), "_last": F.row_number().over(back)})
    part = part.where(((F.col("size") > F.col("low")) | (F.col("_first") > F.col("skip"))) & ((F.col("size") < F.col("high")) | (F.col("_last") > F.col("drop"))))
    kept = taken.where(~edge).unionByName(part.drop("_first", "_last"))
    out = kept.groupBy(*keys, "low", "tag").agg(
        F.expr("CAST(sum(pos) div count(*) AS BIGINT)").alias("_pos"), F.expr("CAST(sum(size) div count(*) AS BIGINT)").alias("_size"), F.count("*").alias("cnt"), (F.sum("mapq") / F.count("*")).cast("double").alias("quality"),
        F.array_sort(F.collect_list(F.struct("size", "pos", "mapq", "read"))).alias("_members"),
    )
    return out.select("contig", F.col("_pos").alias("pos"), F.col("_size").alias("size"), "cnt", "quality", F.col("_members.read").alias("reads"), "tag")


def marks(signals: DataFrame, lengths: DataFrame, point: bool | Column, half: int = 101) -> DataFrame:
    """Where a small signal adds to depth: its span, or `half` positions around a point; cut to the contig."""
    point = F.lit(point) if isinstance(point, bool) else point
    start = F.greatest(F.col("pos") - F.when(point, half).otherwise(1), F.lit(0))
    end = F.col("pos") + F.when(point, F.lit(half)).otherwise(F.col("size"))
    rows = signals.join(lengths.select(F.col("name").alias("contig"), F.col("length").alias("_len")), "contig")
    return rows.select("contig", F.least(start, F.col("_len") - 1).alias("m_from"), F.least(end, F.col("_len")).alias("m_to"))


def in_regions(signals: DataFrame, regions: DataFrame, point: bool | Column, half: int = 50) -> DataFrame:
    """signals with each depth region (r_from, r_to) that they belong to; a signal may have none or several."""
    point = F.lit(point) if isinstance(point, bool) else point
    pos, size = F.col("pos"), F.col("size")
    rows = signals.withColumns({"l_from": F.when(point, F.greatest(pos - half, F.lit(0))).otherwise(pos), "l_to": pos + F.when(point, F.lit(half)).otherwise(size)})
    return overlaps(rows, regions).drop("l_from", "l_to")


def small_regions(signals: DataFrame, lengths: DataFrame, point: bool | Column, max_depth: int) -> DataFrame:
    return depth_regions(settled(depth_segments(marks(signals, lengths, point)))).where(F.col("most") <= max_depth).drop("most")


def signals_of(signals: DataFrame, kind: str) -> DataFrame:
    """Signals of a kind: D, I or INV."""
    return signals.where(F.col("sig_type").startswith(f"{kind}-"))


def large_events(signals: DataFrame, support: int) -> DataFrame:
    return merged(with_cluster(signals.where(F.col("size") > LARGE), ["contig"]), ["contig", "cluster"], support)


def small_events(signals: DataFrame, lengths: DataFrame, support: int, max_depth: int, point: bool | Column) -> DataFrame:
    small = signals.where(F.col("size") <= LARGE)
    return merged(in_regions(small, small_regions(small, lengths, point, max_depth), point), ["contig", "r_from", "r_to"], support)


def clustered(signals: DataFrame, lengths: DataFrame, support: int, max_depth: int, point: bool | Column) -> DataFrame:
    """All events: small ones, and large ones that no small one of a similar size overlaps."""
    small = settled(small_events(signals, lengths, support, max_depth, point))
    return without_small_twin(large_events(signals, support), small, point).unionByName(small)


#: Kinds of signals and what they are events of: deletions expand the assembly, insertions collapse it.
EVENT_TYPES = {"D": "Expansion", "I": "Collapse", "INV": "Inversion"}


def events(signals: DataFrame, lengths: DataFrame, support: int, max_depth: int, min_size: int = 50, max_size: int = 4_000_000) -> DataFrame:
    """contig, start, end, cnt, etype, size, reads, tag.

    Kinds don't meet. They go through one chain of steps, in which a kind's contig has a name of its own: the contig's,
    after the kind and a tab."""
    kind = F.substring_index("sig_type", "-", 1)
    own = signals.where(kind.isin(*EVENT_TYPES)).withColumn("contig", F.concat(kind, F.lit("\t"), "contig"))
    names = lengths.select(F.explode(F.array(*map(F.lit, EVENT_TYPES))).alias("kind"), "name", "length")
    names = names.select(F.concat("kind", F.lit("\t"), "name").alias("name"), "length")
    point = ~F.col("contig").startswith("D\t")
    rows = clustered(own, names, support, max_depth, point).where(F.col("size").between(min_size, max_size))
    etype = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])[F.substring_index("contig", "\t", 1)]
    rows = rows.withColumns({"etype": etype, "contig": F.expr("substring(contig, instr(contig, '\t') + 1)")})
    end = F.col("pos") + F.when(F.col("etype") == "Collapse", 1).otherwise(F.col("size"))
    return rows.select("contig", F.col("pos").alias("start"), end.alias("end"), "cnt", "etype", "size", "reads", "tag")

"""Interval joins by bins, and depth of coverage as a sweep over ends.

An interval is copied to each bin of `width` positions that it touches; intervals of one bin meet by equality, and a pair
counts in the bin where their overlap starts only. Long intervals touch many bins, so `width` should be near the
typical length. Depth is a running sum of ends over positions that have any: rows follow the number of distinct
positions, whatever the number of intervals or the length of a contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contig_stats import running_sum


def overlaps(left: DataFrame, right: DataFrame, width: int = 4096) -> DataFrame:
    """Pairs of rows with equal contig and l_from < r_to and r_from < l_to (half-open, longs).

    left has contig, l_from, l_to and right contig, r_from, r_to, besides columns of other names.
    """
    bins = lambda a, b: F.explode(F.expr(f"sequence({a} div {width}, greatest({b} - 1, {a}) div {width})"))
    one = left.where("l_to > l_from").withColumn("_bin", bins("l_from", "l_to"))
    two = right.where("r_to > r_from").withColumn("_bin", bins("r_from", "r_to"))
    both = one.join(two, ["contig", "_bin"]).where("l_from < r_to AND r_from < l_to")
    return both.where(f"greatest(l_from, r_from) div {width} = _bin").drop("_bin")


def counts_up_to(points: DataFrame, spots: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """spots (keys, at, ...) with upto: the sum of n over points (keys, at, n) at or before `at`.

    Points and spots are sorted together, in ranges of `width` positions; sums of ranges, of which there is a row each,
    are added in a second step."""
    asked = spots.select(*keys, "at", F.lit(None).cast("long").alias("n"), F.struct(*spots.columns).alias("_row"))
    known = points.groupBy(*keys, "at").agg(F.sum("n").alias("n")).withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))
    both = asked.unionByName(known).withColumn("_range", F.expr(f"at div {width}"))
    own = Window.partitionBy(*keys, "_range").orderBy("at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = both.groupBy(*keys, "_range").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_sum"))
    ranges = ranges.select(*keys, "_range", (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = both.withColumn("_inside", F.coalesce(F.sum("n").over(own), F.lit(0))).where("_row IS NOT NULL")
    return inside.join(ranges, [*keys, "_range"]).select("_row.*", (F.col("_before") + F.col("_inside")).cast("long").alias("upto"))


def flank_depth(events: DataFrame, reads: DataFrame, flank: int = 100, width: int = 1 << 16) -> DataFrame:
    """events (contig, start, end, ...) with depth_left, depth_right and depth_min: countable reads (rname, pos, ref_len,
    flag) that overlap the `flank` bases up to start, and those after end (1-based).

    Reads that overlap a window are those that begin up to its last base, less those that end before its first: two
    counts by order, for which reads and windows are sorted once, however many reads lie on a window."""
    counted = reads.where((F.col("flag").bitwiseAND(3844) == 0) & (F.col("ref_len") > 0)).select(F.col("rname").alias("contig"), F.col("pos").cast("long").alias("begin"), (F.col("pos") + F.col("ref_len")).cast("long").alias("stop"))
    point = lambda name, n: F.struct(F.col(name).alias("at"), F.lit(n).cast("long").alias("n"))
    points = counted.select("contig", F.explode(F.array(point("begin", 1), point("stop", -1))).alias("x")).select("contig", (F.col("x.n") < 0).alias("gone"), "x.at", "x.n")
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    ask = lambda gone, left, at: F.struct(F.lit(gone).alias("gone"), F.lit(left).alias("left"), at.alias("at"))
    first = F.greatest(start - flank + 1, F.lit(1).cast("long"))
    asked = F.array(ask(False, True, start), ask(True, True, first), ask(False, False, end + flank), ask(True, False, end + 1))
    spots = events.select("contig", "start", "end").distinct().withColumn("x", F.explode(asked)).select("contig", "start", "end", "x.gone", "x.left", "x.at")
    found = counts_up_to(points, spots, ["contig", "gone"], width)
    side = lambda left, name: F.sum(F.when(F.col("left") == left, F.col("upto")).otherwise(0)).cast("long").alias(name)
    depth = found.groupBy("contig", "start", "end").agg(side(True, "depth_left"), side(False, "depth_right"))
    # A window without bases has no reads.
    depth = depth.withColumn("depth_left", F.when(F.col("start") >= F.greatest(F.col("start") - flank + 1, F.lit(1)), F.col("depth_left")).otherwise(0))
    out = events.join(depth, ["contig", "start", "end"], "left").fillna(0, ["depth_left", "depth_right"])
    return out.withColumn("depth_min", F.least("depth_left", "depth_right"))


def depth_segments(marks: DataFrame, width: int = 1 << 20) -> DataFrame:
    """marks (contig, m_from, m_to: half-open) to contig, seg_from, seg_to, depth: runs of constant depth over 0."""
    ends = marks.where("m_to > m_from").select("contig", F.explode(F.array(F.struct(F.col("m_from").alias("at"), F.lit(1).alias("d")), F.struct(F.col("m_to").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    changes = ends.groupBy("contig", "x.at").agg(F.sum("x.d").alias("d")).where("d <> 0")
    deep = running_sum(changes, ["contig"], "at", "d", "depth", width)
    # The next change: in this range, or the first of the next range that has any.
    deep = deep.withColumn("_range", F.expr(f"at div {width}"))
    firsts = deep.groupBy("contig", "_range").agg(F.min("at").alias("first"))
    firsts = firsts.select("contig", "_range", F.lead("first").over(Window.partitionBy("contig").orderBy("_range")).alias("_after"))
    deep = deep.withColumn("_next", F.lead("at").over(Window.partitionBy("contig", "_range").orderBy("at"))).join(firsts, ["contig", "_range"])
    deep = deep.select("contig", F.col("at").alias("seg_from"), F.coalesce("_next", "_after").alias("seg_to"), "depth")
    return deep.where("depth > 0 AND seg_to IS NOT NULL")


def _hysteresis(rows: list[tuple[int, int, int]], threshold: int) -> list[tuple[int, int, int]]:
    """Regions (from, to, greatest depth) of adjacent segments (from, to, depth). Open above threshold; closed below
    a tenth of the depth reached (threshold at least), at a position that can't open the next one."""
    out, start, most, blocked = [], None, 0, None
    end = None
    for a, b, depth in rows:
        if end is not None and a > end and start is not None:  # a hole: depth 0
            out.append((start, end, most))
            start, blocked = None, end
        at = a
        if start is not None:
            if depth >= max(threshold, most // 10):
                most = max(most, depth)
            else:
                out.append((start, a, most))
                start, blocked = None, a
        if start is None and depth > threshold:
            at = a + 1 if blocked == a else a
            if at < b:
                start, most = at, depth
        end = b
    if start is not None:
        out.append((start, end, most))
    return out


def with_island(segments: DataFrame, width: int = 1 << 20) -> DataFrame:
    """segments (contig, seg_from, seg_to, ...: disjoint) with island: the number, on the contig, of the stretch of
    touching segments. In two steps, ranges of `width` positions and segments of a range, so no task holds a contig."""
    own = Window.partitionBy("contig", "_range").orderBy("seg_from")
    rows = segments.withColumn("_range", F.expr(f"seg_from div {width}"))
    rows = rows.withColumn("_new", (F.col("seg_from") > F.lag("seg_to").over(own)).cast("int"))  # null for the first of a range
    ranges = rows.groupBy("contig", "_range").agg(F.min("seg_from").alias("first"), F.max("seg_to").alias("last"), F.coalesce(F.sum("_new"), F.lit(0)).alias("n"))
    order = Window.partitionBy("contig").orderBy("_range")
    ranges = ranges.withColumn("opens", F.coalesce((F.col("first") > F.lag("last").over(order)).cast("int"), F.lit(1)))
    ranges = ranges.select("contig", "_range", (F.sum(F.col("n") + F.col("opens")).over(order) - F.col("n")).alias("_before"))
    inside = rows.withColumn("_inside", F.sum(F.coalesce("_new", F.lit(0))).over(own))
    return inside.join(ranges, ["contig", "_range"]).withColumn("island", F.col("_before") + F.col("_inside")).drop("_range", "_new", "_before", "_inside")


def depth_regions(segments: DataFrame, threshold: int = 3, width: int = 1 << 20, falls: bool = True) -> DataFrame:
    """contig, r_from, r_to, most: regions where depth rises above threshold and, with falls, stays near what it reached;
    without, stays at threshold or above.

    Segments of depth threshold and above that touch are an island; no region leaves its island. Where an island's depth
    stays below ten times threshold plus ten, or regions end below threshold only, its region is closed-form: from its
    first segment above threshold to its end. Only deeper islands are folded, each on its own.
    """
    rows = with_island(segments.where(F.col("depth") >= threshold), width)
    islands = rows.groupBy("contig", "island").agg(
        F.max("depth").alias("most"), F.min(F.when(F.col("depth") > threshold, F.col("seg_from"))).alias("r_from"), F.max("seg_to").alias("r_to"),
    ).where(F.col("most") > threshold)
    if not falls:
        return islands.select("contig", "r_from", "r_to", "most")
    plain = islands.where(F.col("most") < 10 * (threshold + 1)).select("contig", "r_from", "r_to", "most")
    deep = rows.join(islands.where(F.col("most") >= 10 * (threshold + 1)).select("contig", "island"), ["contig", "island"])

    def fold(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("seg_from")
        found = _hysteresis(list(zip(pdf["seg_from"], pdf["seg_to"], pdf["depth"], strict=True)), threshold)
        return pd.DataFrame([(key[0], *x) for x in found], columns=["contig", "r_from", "r_to", "most"])

    folded = deep.select("contig", "island", "seg_from", "seg_to", "depth").groupBy("contig", "island").applyInPandas(fold, "contig string, r_from long, r_to long, most long")
    return plain.unionByName(folded)


def without_small_twin(large: DataFrame, small: DataFrame, point: bool | Column, ratio: float = 0.8) -> DataFrame:
    """large (contig, pos, size, ...) without rows that a small one of a similar size overlaps; a small one ends at
    pos + 1 where point, else at pos + size."""
    # Sizes within the ratio are in classes next to each other; in a class, an interval touches two or three bins.
    step = 1 / ratio
    spots = lambda df, p, s: df.select("contig", F.col("pos").alias(p), F.col("size").alias(s)).distinct().withColumn("_k", F.floor(F.ln(F.col(s)) / F.ln(F.lit(step))))
    bins = lambda a, b: F.explode(F.expr(f"sequence({a} div _w, {b} div _w)"))
    width = F.greatest(F.pow(F.lit(step), F.col("_k")), F.lit(1.0)).cast("long")
    big = spots(large, "_lp", "_ls").withColumn("_w", width).withColumn("_bin", bins("_lp", "(_lp + _ls)"))
    other = spots(small, "_sp", "_ss").withColumn("_k", F.explode(F.expr("sequence(_k - 2, _k + 2)"))).withColumn("_w", width)
    end = F.col("_sp") + F.when(F.lit(point) if isinstance(point, bool) else point, 1).otherwise(F.col("_ss"))
    other = other.withColumn("_se", end.cast("long")).withColumn("_bin", bins("_sp", "_se")).drop("_w")
    met = (F.least(F.col("_lp") + F.col("_ls"), F.col("_se")) > F.greatest("_lp", "_sp")) & F.col("_ls").between(ratio * F.col("_ss"), F.col("_ss") / ratio)
    twins = big.join(other, ["contig", "_k", "_bin"]).where(met).select("contig", F.col("_lp").alias("pos"), F.col("_ls").alias("size")).distinct()
    return large.join(twins, ["contig", "pos", "size"], "left_anti")

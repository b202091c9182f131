"""Greedy chains over positions, in ranges.

A chain starts at a contig's first position; a start reaches some way, and the first position beyond is the next start. Where
a chain leaves a range of positions depends on nothing but where it enters it, and it can enter only at the first few
positions: those within the longest reach of the range's begin, and the next one. So a range tells for each of these where a
chain would leave, found by doubling jumps from position to position; a contig's ranges are then walked with those
few rows each, and at last each range is marked from its true entry. A task holds a range, or a contig's entries, never a
contig.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled

RANGE = 1 << 16


def nearest(queries: DataFrame, points: DataFrame, keys: list[str], at: Column, beyond: bool, width: int = RANGE) -> DataFrame:
    """queries with near: of the points (keys, pos) the first one beyond `at`, or else the last one up to it; null if there is none.

    Two steps: the nearest one in the range that `at` lies in, else that of the next range that has any; there is a row
    for each range in the second."""
    asked = queries.select(*keys, at.cast("long").alias("_at"), F.struct(*queries.columns).alias("_row"), F.lit(None).cast("long").alias("_point"))
    known = points.select(*keys, F.col("pos").cast("long").alias("_at"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col("pos").cast("long").alias("_point"))
    both = asked.unionByName(known).withColumn("_range", F.expr(f"_at div {width}"))
    # Points at the place that is asked for come first if they count, and last if they don't: either way after the query
    # in an order that goes down from far points, and before it in one that goes up.
    way, last = (F.desc, F.col("_row").isNull()) if beyond else (F.asc, F.col("_row").isNotNull())
    own = Window.partitionBy(*keys, "_range").orderBy(way("_at"), last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = both.groupBy(*keys, "_range").agg((F.min if beyond else F.max)("_point").alias("_edge"))
    over = Window.partitionBy(*keys).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_range", F.last("_edge", ignorenulls=True).over(over).alias("_else"))
    found = both.withColumn("_near", F.last("_point", ignorenulls=True).over(own)).where(F.col("_row").isNotNull())
    return found.join(ranges, [*keys, "_range"]).select("_row.*", F.coalesce("_near", "_else").alias("near"))


def within(spots: DataFrame, keys: list[str], reach: int, sums: dict[str, Column], width: int = RANGE) -> DataFrame:
    """spots (keys, pos, ...) with sums over the spots at most `reach` behind each. A range's window also sees the first spots
    of the next range."""
    bins = F.array(F.expr(f"pos div {width}"), F.expr(f"(pos - {reach}) div {width}"))
    copies = spots.withColumn("_range", F.explode(F.array_distinct(F.filter(bins, lambda x: x >= 0))))
    behind = Window.partitionBy(*keys, "_range").orderBy("pos").rangeBetween(0, reach)
    out = copies.withColumns({c: s.over(behind) for c, s in sums.items()})
    return out.where(F.expr(f"_range = pos div {width}")).drop("_range")


def _next(pos: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The place of the start that would follow each position; the number of positions if there is none."""
    return np.searchsorted(pos, pos + reach, "right")


def leaving(pos: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The place of the last start of a chain from each position, by jumps of 1, 2, 4, ... steps."""
    then = _next(pos, reach)
    last = np.where(then < len(pos), then, np.arange(len(pos)))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def with_start(rows: DataFrame, spots: DataFrame, keys: list[str], widest: int, width: int = 1 << 20) -> DataFrame:
    """rows (keys, pos, ...) with cluster: the start of their chain. spots (keys, pos, reach: at most `widest`; one row a position)
    have all positions of rows."""
    spots = settled(spots.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("reach").cast("long").alias("reach"), F.expr(f"pos div {width}").alias("_range")))
    kinds = ", ".join(f"{k} {dict(spots.dtypes)[k]}" for k in keys)

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, reach = pdf["pos"].to_numpy(np.int64), pdf["reach"].to_numpy(np.int64)
        last = leaving(pos, reach)
        n = min(int(np.searchsorted(pos, int(pdf["_range"].iloc[0]) * width + widest, "right")) + 1, len(pos))
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"_range": pdf["_range"].iloc[0], "entry": pos[:n], "last": pos[last[:n]], "end": (pos + reach)[last[:n]]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        end, last, out = -1, -1, []
        for at, own in pdf.sort_values(["_range", "entry"]).groupby("_range"):
            entries = own["entry"].to_numpy()
            k = int(np.searchsorted(entries, end, "right"))
            out.append((at, int(entries[k]) if k < len(entries) else -1, last))
            if k < len(entries):
                last, end = int(own["last"].iloc[k]), int(own["end"].iloc[k])
        return pd.DataFrame(out, columns=["_range", "entry", "before"]).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "_range", "entry", "before"]]

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, entry = pdf["pos"].to_numpy(np.int64), int(pdf["entry"].iloc[0])
        cluster = np.full(len(pos), int(pdf["before"].iloc[0]))
        if entry >= 0:
            then, k = _next(pos, pdf["reach"].to_numpy(np.int64)), int(np.searchsorted(pos, entry))
            while k < len(pos):
                cluster[k : then[k]] = pos[k]
                k = int(then[k])
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"pos": pos, "cluster": cluster})

    entries = spots.groupBy(*keys, "_range").applyInPandas(enter, f"{kinds}, _range long, entry long, last long, end long")
    entries = entries.groupBy(*keys).applyInPandas(walk, f"{kinds}, _range long, entry long, before long")
    marked = spots.join(entries, [*keys, "_range"]).groupBy(*keys, "_range").applyInPandas(mark, f"{kinds}, pos long, cluster long")
    return rows.join(marked, [*keys, "pos"])

"""Reads kept to a running budget of bases, and dealt to parts in turn.

A read is kept while fewer bases are kept than the budget allows: a share of all bases up to and with this read. That is a
rule from read to read, but two runs of it from different states meet before long, and from then on are the same. So blocks
of reads are folded at once, each from a guessed state; then every block takes the state in which the block before ended,
and is folded again until it meets its own run. Blocks whose end changes pass it on: to the next ones of a group at once,
and in another round, with groups twice as large, to those behind it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import forgotten, settled


def with_number(rows: DataFrame, order: list[str | Column], by: Column, width: int = 1 << 16) -> DataFrame:
    """rows with number: their place from 0 in `order`, which goes by the long `by` first. Two steps: within ranges of `by`, then
    over ranges."""
    cut = rows.withColumn("_range", F.floor(by / width))
    ranges = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    ranges = ranges.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return cut.withColumn("_inside", inside).join(ranges, "_range").withColumn("number", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def kept_run(lengths: list[int], total: int, written: int, fraction: float) -> tuple[int, list[bool]]:
    """The rule over reads' lengths: the bases kept at their end, and whether each is kept."""
    out = []
    for n in lengths:
        total += n
        keep = written < math.floor(total * fraction)
        written += n if keep else 0
        out.append(keep)
    return written, out


def _ends(lengths: list[int], total: int, old: int, new: int, end: int, fraction: float) -> int:
    """Where a run from the state `new` ends: at `end`, if it meets that from `old`."""
    for n in lengths:
        if old == new:
            return end
        total += n
        budget = math.floor(total * fraction)
        old += n if old < budget else 0
        new += n if new < budget else 0
    return new if old != new else end


def within_budget(reads: DataFrame, fraction: float, block: int = 100_000, most: int = 200_000) -> DataFrame:
    """The reads (number: dense from 0; bases: their length) that are kept, with turn: their place among those kept, from 0."""
    fraction = min(max(fraction, 0.0), 1.0)
    if fraction in (0.0, 1.0):
        return reads.where(F.lit(fraction == 1.0)).withColumn("turn", F.col("number"))
    lengths = settled(reads.select((F.floor(F.col("number") / block)).alias("block"), "number", F.coalesce(F.col("bases"), F.lit(0)).cast("long").alias("bases")))
    order = Window.orderBy("block")  # a row a block
    sums = lengths.groupBy("block").agg(F.sum("bases").alias("_sum"))
    sums = settled(sums.select("block", (F.sum("_sum").over(order) - F.col("_sum")).alias("total")))
    state = sums.withColumns({"start": F.lit(-1).cast("long"), "told": F.floor(F.col("total") * F.lit(fraction)).cast("long"), "end": F.lit(-1).cast("long")})
    schema = "block long, total long, start long, end long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """Neighbouring blocks, one after the other. One with a new start is folded until it meets its own run; where its end
        is another one, the next block starts there. Only blocks that change are given."""
        out, moved, ends = [], None, None
        for block, own in pdf.sort_values("number").groupby("block"):
            first, lengths = own.iloc[0], own["bases"].tolist()
            total, old, end = int(first["total"]), int(first["start"]), int(first["end"])
            new = moved if moved is not None and ends == block else int(first["told"])
            moved = ends = None
            if end < 0:
                moved, ends = kept_run(lengths, total, new, fraction)[0], block + 1
            elif new != old:
                now = _ends(lengths, total, old, new, end, fraction)
                moved, ends = (now, block + 1) if now != end else (None, None)
            else:
                continue
            out.append((block, total, new, end if moved is None else moved))
        return pd.DataFrame(out, columns=["block", "total", "start", "end"])

    # Runs from two states may not meet within a block: so each round folds twice as many neighbours in a task, up to `most`
    # reads, and the number of rounds grows with the logarithm of how many blocks a run takes to meet another.
    together = 1
    run = lambda told: lengths.join(told, "block").groupBy(F.expr(f"block div {together}")).applyInPandas(fold, schema)
    done = settled(run(state))
    while True:
        told = done.withColumn("told", F.coalesce(F.lag("end").over(order), F.lit(0)))
        together *= 2 if 2 * together * block <= most else 1
        told = settled(told.withColumn("_group", F.expr(f"block div {together}")))
        wrong = told.where("told <> start").select("_group").distinct()
        if wrong.isEmpty():
            break
        told = told.join(wrong, "_group", "left_semi").drop("_group")
        again = settled(run(told))
        before, done = done, settled(done.join(again.select("block"), "block", "left_anti").unionByName(again))
        forgotten(before, again)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        first, pdf = pdf.iloc[0], pdf.sort_values("number")
        keep = kept_run(pdf["bases"].tolist(), int(first["total"]), int(first["start"]), fraction)[1]
        numbers = pdf["number"][keep]
        return pd.DataFrame({"number": numbers, "block": first["block"], "_turn": range(len(numbers))})

    marked = settled(lengths.join(done.select("block", "total", "start"), "block").groupBy("block").applyInPandas(mark, "number long, block long, _turn long"))
    counts = marked.groupBy("block").agg(F.count("*").alias("_n"))
    counts = counts.select("block", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    turns = marked.join(counts, "block").select("number", (F.col("_before") + F.col("_turn")).alias("turn"))
    return reads.join(turns, "number")

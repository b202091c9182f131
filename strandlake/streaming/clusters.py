"""Greedy clusters over a stream of signals, closed as the watermark of positions passes them.

Positions are the stream's event time: a second each. A contig's signals may come in any order as long as none is later
than the watermark allows. State holds the counts of the positions that the watermark hasn't passed and the one cluster that
is open, never the signals themselves; a cluster is given out once no further signal can reach it. All signals of a contig
go to one task, as a chain is serial.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.clusters import WINDOW

OUT = "contig string, cluster long, n long, last long, bases long"
STATE = "pos array<long>, n array<long>, bases array<long>, open array<long>"


def advance(spots: dict[int, tuple[int, int]], opened: list[int], upto: int, window: int) -> tuple[list[list[int]], list[int]]:
    """The clusters (start, n, last, bases) that are closed when all positions up to one have come, and the open one. What
    is taken goes from spots (position to rows and bases)."""
    closed = []
    for pos in sorted(p for p in spots if p <= upto):
        n, bases = spots.pop(pos)
        if opened and pos <= opened[0] + window:
            opened = [opened[0], opened[1] + n, pos, opened[3] + bases]
        else:
            if opened:
                closed.append(opened)
            opened = [pos, n, pos, bases]
    if opened and opened[0] + window <= upto:
        closed.append(opened)
        opened = []
    return closed, opened


def cluster_stream(signals: DataFrame, window: int = WINDOW, late: int = 0) -> DataFrame:
    """signals (contig, pos, size) to clusters (contig, cluster, n, last, bases; output mode append). late: how many positions
    a signal may come behind the farthest one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, n, bases, opened = tuple(state.get) if state.exists else ([], [], [], [])
        spots = dict(zip(pos, zip(n, bases, strict=True), strict=True))
        for batch in batches:
            for p, count, size in zip(batch["pos"].tolist(), batch["n"].tolist(), batch["bases"].tolist(), strict=True):
                before = spots.get(p, (0, 0))
                spots[p] = (before[0] + count, before[1] + size)
        mark = state.getCurrentWatermarkMs() // 1000  # no row up to here comes any more
        closed, opened = advance(spots, list(opened), mark, window)
        order = sorted(spots)
        if order or opened:
            state.update((order, [spots[p][0] for p in order], [spots[p][1] for p in order], opened))
            due = opened[0] + window if opened else order[0]
            state.setTimeoutTimestamp(1000 * max(due, mark + 1))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame([[key[0], *c] for c in closed], columns=["contig", "cluster", "n", "last", "bases"])

    rows = signals.withColumn("at", F.timestamp_seconds("pos")).withWatermark("at", f"{late + 1} seconds")
    rows = rows.select("at", "contig", F.col("pos").cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), F.col("size").cast("long").alias("bases"))
    return rows.groupBy("contig").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)

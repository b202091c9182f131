"""Sequences as tables of pieces, so that no row and no task has to hold a contig.

A contig is rows (name, piece, offset, text): `text` are its characters from `offset` on, and piece k begins at k * WIDTH. An
edit goes to the pieces that it touches by a join on (name, piece), and what lies behind it moves by a sum of length changes
that is made in two steps, over positions of a range and over ranges.

Edits that may meet are worked out together, without any text: as spans of the source, of its reverse complement, and
runs of N (see `folded`). Only then text is cut, a piece at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled

WIDTH = 1 << 20
#: What a span shows of its source: it as it is, its reverse complement, it after two such turns (small letters have become
#: capitals), or as many N.
SAME, TURNED, TWICE, UNKNOWN = 0, 1, 2, 3
TURN = {SAME: TURNED, TURNED: TWICE, TWICE: TURNED, UNKNOWN: UNKNOWN}
COMPLEMENT = str.maketrans("ACGTacgt", "TGCATGCA")
CAPITAL = str.maketrans("acgt", "ACGT")


def pieces_of(contigs: DataFrame, width: int = WIDTH) -> DataFrame:
    """contigs (name, sequence) in pieces. Null and empty sequences have none."""
    parts = F.posexplode(F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("piece", "text")
    return contigs.where("sequence <> ''").select("name", parts).select("name", F.col("piece").cast("long").alias("piece"), (F.col("piece").cast("long") * width).alias("offset"), "text")


def whole(pieces: DataFrame) -> DataFrame:
    """name, sequence: for contigs that are small enough for a row."""
    parts = pieces.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("p"))
    return parts.select("name", F.array_join("p.text", "").alias("sequence"))


def lengths(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("name").agg(F.max(F.col("offset") + F.length("text")).alias("length"))


def gridded(fragments: DataFrame, width: int = WIDTH) -> DataFrame:
    """fragments (name, offset, text: disjoint, of any lengths) as pieces."""
    return assembled(at_borders(fragments, width), width)


def at_borders(fragments: DataFrame, width: int) -> DataFrame:
    """name, piece, offset, text: fragments cut at the borders of pieces."""
    first = F.lit(width) - F.col("offset") % width
    # A fragment's parts: up to the first border, then a border's width each.
    head, tail = F.expr("substring(text, 1, CAST(_first AS INT))"), F.expr("substring(text, CAST(_first + 1 AS INT))")
    parts = F.concat(F.array(F.struct(F.col("offset").alias("offset"), head.alias("text"))), F.transform(
        F.regexp_extract_all(tail, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), lambda t, k: F.struct((F.col("offset") + F.col("_first") + k * width).alias("offset"), t.alias("text"))
    ))
    return fragments.where("text <> ''").withColumn("_first", first).select("name", F.explode(parts).alias("x")).select("name", F.expr(f"x.offset div {width}").alias("piece"), "x.offset", "x.text")


def assembled(parts: DataFrame, width: int) -> DataFrame:
    """parts (name, piece, offset, text) as pieces. A piece's parts meet in one row of `width` characters at most."""
    joined = parts.groupBy("name", "piece").agg(F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("p"))
    return joined.select("name", "piece", (F.col("piece") * width).alias("offset"), F.array_join("p.text", "").alias("text"))


def with_group(edits: DataFrame, width: int = WIDTH) -> DataFrame:
    """edits (chrom, start, end, ...) with group: a stretch of ranges of `width` starts, over whose begin no island reaches.

    Edits are an island where they may meet, whatever they take or make. An edit takes end - start characters, and what
    others behind it took may make it reach further: so an island is what a queue calls a busy period, in which an edit arrives at
    its start and takes that many characters and one more. When a range's edits are done depends on when those of the ranges before are:
    later by all that they take, but not before what they take on their own. There is a row a range for that."""
    rows = edits.withColumns({"_range": F.expr(f"start div {width}"), "_takes": F.greatest(F.col("end") - F.col("start"), F.lit(0)) + 1})
    own = Window.partitionBy("chrom", "_range").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_slack", F.col("start") - F.sum("_takes").over(own) + F.col("_takes"))
    ranges = rows.groupBy("chrom", "_range").agg(F.min("start").alias("first"), F.sum("_takes").alias("takes"), (F.max("_slack") + F.sum("_takes")).alias("alone"))
    order = Window.partitionBy("chrom").orderBy("_range")
    upto = F.sum("takes").over(order)
    ranges = ranges.withColumn("_done", F.col("alone") - upto).withColumn("_upto", upto)
    before = F.max("_done").over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.col("_upto") - F.col("takes")
    ranges = ranges.withColumn("_free", F.coalesce((before <= F.col("first")).cast("int"), F.lit(1)))
    groups = ranges.select("chrom", "_range", F.sum("_free").over(order).alias("group"))
    return rows.join(groups, ["chrom", "_range"]).drop("_range", "_takes", "_slack")


def islands(edits: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Runs of edits (start, end, ...), sorted by start, that may meet: see with_group."""
    own, done = [], 0
    for e in edits:
        if own and e[0] >= done:
            yield own
            own = []
        done = max(done, e[0]) + max(e[1] - e[0], 0) + 1 if own else e[0] + max(e[1] - e[0], 0) + 1
        own.append(e)
    if own:
        yield own


def folded(edits: list[tuple[int, int, str, int]], length: int, structural: bool) -> tuple[int, int, list[tuple[int, int, int]]]:
    """An island's edits (start, end, type, size), applied from the last to the first: the region of the source (from, to)
    that changes, and the spans (kind, from, to) that stand there afterwards.

    Base edits: a SNP becomes N, inserted bases go, deleted ones come back as N. Structural ones: a deletion becomes at most
    its span of N, an insertion goes, an inversion is turned back. An edit out of range changes nothing."""
    region = min(e[0] for e in edits) + sum(max(e[1] - e[0], 0) + 1 for e in edits)
    last = at = min(max(region, 0), length)
    # What lies behind the current edit; the last one is the leftmost. Other islands are behind the region, so only at a
    # contig's end it matters how long the contig is now.
    behind: list[tuple[int, int, int]] = []
    n = length

    def take(size: int) -> list[tuple[int, int, int]]:
        """The next characters, no more than there are."""
        out = []
        while size > 0 and behind:
            kind, a, b = behind.pop()
            m = min(size, b - a)
            if m < b - a:
                behind.append((kind, a, b - m) if kind == TURNED else (kind, a + m, b))
            out.append((kind, b - m, b) if kind == TURNED else (kind, a, a + m))
            size -= m
        return out

    for start, end, kind, size in sorted(edits, reverse=True):
        size = abs(size)
        if not 0 <= start < n or start >= length:
            continue
        ordered = start <= end
        if kind in ("deletion", "DEL"):
            if structural and not ordered:
                continue
            gone, new = (end - start, min(size, end - start)) if structural else (0, size)
        elif kind in ("insertion", "INS") and ordered and end < n:
            gone, new = end - start, 0
        elif kind == "SNP" and not structural:
            gone, new = 1, 1
        elif kind in ("inversion", "INV") and structural and ordered and end <= n:
            gone, new = end - start, None
        else:
            continue
        if start < at:
            behind.append((SAME, start, at))
            at = start
        old = take(gone)
        if new is None:
            behind += [(TURN[k], a, b) for k, a, b in old]  # the first taken is now the last, so the stack's order holds
            continue
        if new:
            behind.append((UNKNOWN, 0, new))
        n += new - sum(b - a for _, a, b in old)
    return at, last, behind[::-1]


def shown(text: str, offset: int, kind: int, a: int, b: int) -> str:
    """A span of the source, of which `text` is what begins at offset."""
    if kind == UNKNOWN:
        return "N" * (b - a)
    part = text[a - offset : b - offset]
    return part[::-1].translate(COMPLEMENT) if kind == TURNED else part.translate(CAPITAL) if kind == TWICE else part


def mended(text: str, edits: list[tuple], structural: bool) -> str:
    """A text that is held whole, after its edits (start, end, type, size)."""
    out, at = [], 0
    for island in islands(iter(sorted(e for e in edits if None not in e and 0 <= e[0] < len(text)))):
        begin, end, spans = folded(island, len(text), structural)
        if begin < end:
            out += [text[at:begin], *(shown(text, 0, *s) for s in spans)]
            at = end
    return "".join([*out, text[at:]])


def spans_of(edits: DataFrame, sizes: DataFrame, structural: bool, width: int = WIDTH) -> DataFrame:
    """edits (chrom, start, end, sv_type, size) of contigs (name, length) as regions that change: name, region_from, region_to,
    change (of length), group, upto (the changes in the group up to and with this one), and the spans that stand there: kind, a, b, out (their
    place from region_from on)."""
    rows = edits.select("chrom", *(F.col(c).cast("long").alias(c) for c in ("start", "end")), "sv_type", F.col("size").cast("long").alias("size"))
    rows = rows.where("chrom IS NOT NULL AND start >= 0 AND end IS NOT NULL AND sv_type IS NOT NULL AND size IS NOT NULL").join(sizes.withColumnRenamed("name", "chrom"), "chrom").where("start < length")
    rows = with_group(rows, width).repartition("chrom", "group").sortWithinPartitions("chrom", "group", "start")
    fields = {"name": pa.string(), "group": pa.int64()} | dict.fromkeys(("region_from", "region_to", "change", "upto"), pa.int64()) | {"spans": pa.list_(pa.struct([(c, pa.int64()) for c in ("kind", "a", "b", "out")]))}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_by_one = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True))
        out: list[tuple] = []
        for (name, group, length), own in groupby(one_by_one, key=lambda r: r[:3]):
            upto = 0
            for island in islands(r[3:] for r in own):
                begin, end, spans = folded(island, length, structural)
                if begin < end:
                    places, n = [], 0
                    for kind, a, b in spans:
                        places.append({"kind": kind, "a": a, "b": b, "out": n})
                        n += b - a
                    upto += n - (end - begin)
                    out.append((name, group, begin, end, n - (end - begin), upto, places))
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(fields.values())], list(fields))

    ordered = rows.select("chrom", "group", "length", "start", "end", "sv_type", "size")
    return ordered.mapInArrow(fold, "name string, group long, region_from long, region_to long, change long, upto long, spans array<struct<kind: long, a: long, b: long, out: long>>")


def _touched(rows: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """rows with each piece that [a, b) touches (that of a, if it is empty)."""
    return rows.withColumn("piece", F.explode(F.expr(f"sequence({a} div {width}, greatest({b} - 1, {a}) div {width})")))


def _cutter(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each piece (name, offset, text, moved, regions, cuts): what no region covers, moved by the changes before it, and what
    its cuts (from, to, kind, out) show, as parts (name, piece, offset, text) of new pieces."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["name", "piece", "offset", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            small = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            for text, name, offset, moved, regions, cuts in zip(batch.column(2), *small, strict=True):
                text = text.as_py()
                stop, at, shift, shows = offset + len(text), offset, moved, []
                for k, r in enumerate(regions or ()):
                    shift = r["moved"] if k == 0 else shift
                    if (to := min(stop, r["region_from"])) > at:
                        shows.append((at + shift, text[at - offset : to - offset]))
                    at, shift = max(offset, r["region_to"]), r["moved"] + r["change"]
                if stop > at:
                    shows.append((at + shift, text[at - offset :]))
                shows += [(c["out"], shown(text, offset, c["kind"], c["from"], c["to"])) for c in cuts or ()]
                for place, part in shows:
                    first = width - place % width
                    for a in range(first - width, len(part), width):
                        own = part[max(a, 0) : a + width]
                        if own:
                            begin = place + max(a, 0)
                            out.append((name, begin // width, begin, own))
                    held += len(part) + 64
                if held > 1 << 20:
                    yield as_batch(out)
                    out, held = [], 0
        yield as_batch(out)

    return run


def patched(pieces: DataFrame, edits: DataFrame, structural: bool, width: int = WIDTH) -> DataFrame:
    """pieces after edits (chrom, start, end, sv_type, size)."""
    found = settled(spans_of(edits, lengths(pieces), structural, width))
    # How far a region's begin has moved: the changes before it, in its group and in those before. Regions are disjoint.
    groups = found.groupBy("name", "group").agg(F.sum("change").alias("_sum"))
    groups = groups.select("name", "group", (F.sum("_sum").over(Window.partitionBy("name").orderBy("group")) - F.col("_sum")).alias("_before"))
    moved = F.col("_before") + F.col("upto") - F.col("change")
    regions = settled(found.join(groups, ["name", "group"]).select("name", "region_from", "region_to", "change", moved.cast("long").alias("moved"), "spans"))
    spans = regions.select("name", (F.col("region_from") + F.col("moved")).alias("_at"), F.explode("spans").alias("s"))
    spans = spans.select("name", "s.kind", "s.a", "s.b", (F.col("_at") + F.col("s.out")).alias("out")).where("b > a")
    size = F.col("b") - F.col("a")
    regions = regions.drop("spans")
    # What stays of a piece is what no region covers; it moves by all changes before it, those of earlier pieces first.
    cut = _touched(regions, "region_from", "region_to", width).groupBy("name", "piece").agg(F.array_sort(F.collect_list(F.struct("region_from", "region_to", "moved", "change"))).alias("regions"))
    sums = regions.groupBy("name", F.expr(f"region_from div {width}").alias("piece")).agg(F.sum("change").alias("change"))
    where = pieces.select("name", "piece").join(sums, ["name", "piece"], "left").join(cut, ["name", "piece"], "left")
    before = F.sum(F.coalesce("change", F.lit(0))).over(Window.partitionBy("name").orderBy("piece")) - F.coalesce("change", F.lit(0))
    where = where.select("name", "piece", before.alias("moved"), "regions")
    # Spans of the source, cut at the borders of pieces; a turned one goes on from its end.
    used = _touched(spans.where(F.col("kind") != UNKNOWN), "a", "b", width)
    a, b = F.greatest(F.col("a"), F.col("piece") * width), F.least(F.col("b"), (F.col("piece") + 1) * width)
    out = F.col("out") + F.when(F.col("kind") == TURNED, F.col("b") - b).otherwise(a - F.col("a"))
    used = used.select("name", "piece", F.struct(a.alias("from"), b.alias("to"), F.col("kind"), out.alias("out")).alias("cut"))
    cuts = used.groupBy("name", "piece").agg(F.collect_list("cut").alias("cuts"))
    every = pieces.join(where, ["name", "piece"]).join(cuts, ["name", "piece"], "left").select("name", "offset", "text", "moved", "regions", "cuts")
    parts = every.mapInArrow(_cutter(width), "name string, piece long, offset long, text string")
    runs = spans.where(F.col("kind") == UNKNOWN).select("name", "out", F.explode(F.expr(f"sequence(0L, (b - a - 1) div {width})")).alias("k"), size.alias("n"))
    runs = runs.select("name", (F.col("out") + F.col("k") * width).alias("offset"), F.repeat(F.lit("N"), F.least(F.col("n") - F.col("k") * width, F.lit(width)).cast("int")).alias("text"))
    return assembled(parts.unionByName(at_borders(runs, width)), width)

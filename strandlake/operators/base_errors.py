"""Small-scale errors: candidates in pileup columns, tested by a binomial tail.

A pileup row is judged by column expressions alone. The test's p-value depends on (support, depth) only, so it is
computed once for each distinct pair and joined back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import binomial_tail, indel_sequences, most_frequent, normalized_pileup, occurrences
from .pieces import pieces_of
from .settle import settled

STRIPPED = r"[+-]\d+[ACGTNacgtn]+"


def with_symbols(pileup: DataFrame) -> DataFrame:
    """pileup (contig, pos, ref, depth, bases) with normal bases, effective depth, and counts of symbols."""
    out = pileup.withColumn("norm", normalized_pileup(F.col("bases")))
    out = out.withColumns({"stripped": F.regexp_replace("norm", STRIPPED, ""), "deleted": occurrences(F.col("norm"), "*")})
    counts = {f"n_{x.lower()}": occurrences(F.col("stripped"), x) for x in "ATCG"}
    return out.withColumns({"eff": F.col("depth") - F.col("deleted"), "same": occurrences(F.col("norm"), ".")} | counts)


def is_valid(maxcov: Column, min_depth: int | None = None) -> Column:
    """A column counts where its reference is known and its depth in range."""
    least = F.lit(min_depth) if min_depth is not None else F.floor(maxcov / 10)
    return (F.col("ref") != "N") & F.col("depth").between(least, maxcov)


def valid_bases(pileup: DataFrame, min_depth: int | None = None) -> DataFrame:
    """contig, valid_bases of pileup rows with maxcov."""
    return pileup.groupBy("contig").agg(F.count_if(is_valid(F.col("maxcov"), min_depth)).alias("valid_bases"))


def candidates(pileup: DataFrame, min_depth: int | None = None) -> DataFrame:
    """contig, start, end, etype, size, support, depth: up to three candidate errors of a pileup row (with mincount and
    maxcov of its contig)."""
    rows = with_symbols(pileup).where(is_valid(F.col("maxcov"), min_depth))
    rows = rows.where((F.col("depth") >= F.col("mincount")) & (F.col("eff") > 0) & (F.col("eff") <= F.col("maxcov")))
    rows = rows.withColumn("least", F.greatest(0.2 * F.col("eff"), F.col("mincount").cast("double")))
    short = lambda m: F.filter(indel_sequences(F.col("norm"), m), lambda s: F.length(s) <= F.floor(F.col("mincount") / 2))
    rows = rows.withColumns({"ins": short("+"), "dels": short("-")})
    rows = rows.withColumns({"ins_size": F.length(most_frequent(F.col("ins"))).cast("long"), "del_size": F.length(most_frequent(F.col("dels"))).cast("long"), "best": F.greatest("n_a", "n_t", "n_c", "n_g")})

    def error(kind: str, start: Column, end: Column, size: Column, support: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(kind).alias("etype"), size.cast("long").alias("size"), support.cast("long").alias("support"))

    pos, n_ins, n_del = F.col("pos"), F.size("ins"), F.size("dels")
    differs = (F.col("same") + F.col("deleted")) <= 0.8 * F.col("depth")
    found = F.array(
        F.when((n_ins > 0) & (n_ins >= F.col("least")), error("insertion", pos - 1, pos, F.col("ins_size"), n_ins)),
        F.when((n_del > 0) & (n_del >= F.col("least")), error("deletion", pos - 1, pos - 1 + F.col("del_size"), F.col("del_size"), n_del)),
        F.when(differs & (F.col("best") > 0) & (F.col("best") >= F.col("least")), error("SNP", pos - 1, pos, F.lit(1), F.col("best"))),
    )
    return rows.select("contig", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"), F.col("eff").alias("depth")).select("contig", "x.*", "depth")


def with_p_value(errors: DataFrame, rate: float) -> DataFrame:
    """errors with pvalue: the chance of more than support - 1 errors among depth at the given rate."""
    pairs = errors.select("support", "depth").distinct()
    return errors.join(pairs.withColumn("pvalue", binomial_tail(F.col("support"), F.col("depth"), rate)), ["support", "depth"])


def significant(errors: DataFrame, config: Config) -> DataFrame:
    tested = with_p_value(errors.where((F.col("depth") != 0) & (F.col("support") >= config.read_cutoff * F.col("depth"))), config.null_rate)
    return tested.where(F.col("pvalue") < config.p_cutoff(F.col("depth"))).select("contig", "start", "end", "etype", "size", "support", "depth", "pvalue")


def error_counts(errors: DataFrame) -> DataFrame:
    """One row. An insertion in reads is a collapse of the assembly, a deletion an expansion."""
    n = lambda kind, name: F.count_if(F.col("etype") == kind).alias(name)
    return errors.agg(F.count("*").alias("n_errors"), n("insertion", "n_collapse"), n("deletion", "n_expansion"), n("SNP", "n_substitution"))


CIGAR_STEP = re.compile(r"(\d+)([MIDNSHP=X])")
PARTS = "contig string, cell long, kind string, at long, n long, text string"


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """PARTS of reads (contig, pos, cigar, seq), cut at the borders of cells of `width` positions, which count from 0: aligned
    runs with their bases (M), deleted ones (D), and marks (I) at the position that an indel follows."""
    names = [x.split()[0] for x in PARTS.split(", ")]
    as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k in (1, 3, 4) else pa.string()) for k in range(6)], names)
    out, held = [], 0
    for batch in batches:
        for contig, pos, cigar, seq in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            at, query, seq = pos - 1, 0, "" if seq == "*" else seq.upper()
            for n, op in CIGAR_STEP.findall(cigar):
                n = int(n)
                aligned = op in "M=X"
                if op in "ID" and at > pos - 1:
                    out.append((contig, (at - 1) // width, "I", at - 1, 0, f"+{n}{seq[query : query + n]}" if op == "I" else f"-{n}{'N' * n}"))
                if aligned or op == "D":
                    # A read whose bases are unknown, or end before its runs do, has none there.
                    stop = at + min(n, max(len(seq) - query, 0)) if aligned else at + n
                    a = at
                    while a < stop:
                        b = min(stop, (a // width + 1) * width)
                        out.append((contig, a // width, "M" if aligned else "D", a, b - a, seq[query + a - at : query + b - at] if aligned else ""))
                        held += b - a
                        a = b
                at += n if aligned or op in "DN" else 0
                query += n if aligned or op in "IS" else 0
            if held > 1 << 20 or len(out) > 20_000:
                yield as_batch(out)
                out, held = [], 0
    yield as_batch(out)


def _mismatches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """contig, cell, at, symbol, n: bases that differ from the reference, of rows (contig, cell, at, text, ref: of the cell)."""
    for batch in batches:
        found: Counter = Counter()
        for contig, cell, at, text, ref in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            first = at - cell * width
            own = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
            other = np.zeros(len(own), np.uint8)
            known = np.frombuffer(ref[first : first + len(own)].encode("latin-1", "replace"), np.uint8)
            other[: len(known)] = known
            found.update((contig, cell, at + k, text[k]) for k in np.flatnonzero(own != other).tolist())
        keys = list(found)
        yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in keys], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))), pa.array(list(found.values()), pa.int64())], ["contig", "cell", "at", "symbol", "n"])


def _columns(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """contig, pos, ref, depth, bases of the cells (contig, cell, ref, changes: at, d, deleted; symbols: at, symbol, n)."""
    for batch in batches:
        for contig, cell, ref, changes, symbols in zip(*batch.columns, strict=True):
            contig, first, ref = contig.as_py(), cell.as_py() * width, ref.as_py()
            steps = np.zeros((2, width + 1), np.int64)
            at = np.array([x["at"] for x in changes.as_py()]) - first
            for k, name in enumerate(("d", "deleted")):
                steps[k, at] = [x[name] for x in changes.as_py()]
            depth, deleted = np.cumsum(steps, axis=1)[:, :width]
            where = np.flatnonzero(depth[: len(ref)] > 0)
            own: dict[int, list] = {}
            for x in symbols.as_py() or ():
                own.setdefault(x["at"] - first, []).append((len(x["symbol"]) > 1, len(x["symbol"]), x["symbol"], x["n"]))
            bases, refs = [], []
            for p, n, gone in zip(where.tolist(), depth[where].tolist(), deleted[where].tolist(), strict=True):
                base = ref[p : p + 1]
                refs.append(base)
                some = own.get(p, [])
                same = n - gone - sum(x[3] for x in some if not x[0])
                if not some and not gone:
                    bases.append("." * n)
                    continue
                # In order of bases, matches in the place of the base that they match; then marks, short ones first.
                some = sorted([*some, (False, 1, "*", gone), (False, 1, base, -same)])
                bases.append("".join("." * -m if m < 0 else symbol * m for _, _, symbol, m in some))
            yield pa.RecordBatch.from_arrays([pa.array([contig] * len(where), pa.string()), pa.array(where + first + 1), pa.array(refs, pa.string()), pa.array(depth[where]), pa.array(bases, pa.string())], ["contig", "pos", "ref", "depth", "bases"])


def native_pileup(alignments: DataFrame, sequences: DataFrame, min_mapq: int = 20, width: int = 4096) -> DataFrame:
    """pileup_of_pieces of whole contigs (name, sequence)."""
    return pileup_of_pieces(alignments, pieces_of(sequences, width), min_mapq, width)


def pileup_of_pieces(alignments: DataFrame, pieces: DataFrame, min_mapq: int = 20, width: int = 4096) -> DataFrame:
    """contig, pos, ref, depth, bases from alignments (rname, pos, flag, mapq, cigar, seq) and contigs in pieces (name, piece,
    text) of `width` positions.

    Reads are cut at the pieces' borders and compared with them piece by piece. Depth is a running sum over where runs begin
    and end; a base is a row only where it differs, a mark once for an indel. So the work is linear in bases, and a task
    holds a piece with its counts, whatever the depth. Symbols are `.` for a match, the base for a mismatch, and `*` for deleted
    bases; after them come the marks of insertions (`+2AC`) and deletions (`-1N`) that begin behind the column, which don't
    add to depth. Unmapped, secondary, failed and duplicate reads are left out, supplementary ones stay; rows that lack a
    column, and what lies beyond a contig's end, are left out."""
    reads = alignments.where((F.col("flag").bitwiseAND(4 + 256 + 512 + 1024) == 0) & (F.col("mapq") >= min_mapq) & (F.col("pos") > 0))
    reads = reads.select("rname", F.col("pos").cast("long").alias("pos"), "cigar", "seq").dropna()
    parts = settled(reads.mapInArrow(lambda x: _parts(x, width), PARTS))
    own = pieces.select(F.col("name").alias("contig"), F.col("piece").alias("cell"), F.upper("text").alias("ref"))
    compared = parts.where("kind = 'M'").join(own, ["contig", "cell"]).select("contig", "cell", "at", "text", "ref")
    symbols = compared.mapInArrow(lambda x: _mismatches(x, width), "contig string, cell long, at long, symbol string, n long")
    marks = parts.where("kind = 'I'").groupBy("contig", "cell", "at", F.col("text").alias("symbol")).agg(F.count("*").alias("n"))
    symbols = symbols.unionByName(marks).groupBy("contig", "cell", "at", "symbol").agg(F.sum("n").alias("n"))
    symbols = symbols.groupBy("contig", "cell").agg(F.collect_list(F.struct("at", "symbol", "n")).alias("symbols"))
    runs = parts.where("kind <> 'I'").groupBy("contig", "cell", "kind", "at", "n").agg(F.count("*").alias("m"))
    ends = F.explode(F.array(F.struct("at", F.col("m").alias("d")), F.struct((F.col("at") + F.col("n")).alias("at"), (-F.col("m")).alias("d")))).alias("x")
    changes = runs.select("contig", "cell", "kind", ends).groupBy("contig", "cell", "x.at").agg(F.sum("x.d").alias("d"), F.sum(F.when(F.col("kind") == "D", F.col("x.d")).otherwise(0)).alias("deleted"))
    changes = changes.groupBy("contig", "cell").agg(F.collect_list(F.struct("at", "d", "deleted")).alias("changes"))
    cells = changes.join(own, ["contig", "cell"]).join(symbols, ["contig", "cell"], "left").select("contig", "cell", "ref", "changes", "symbols")
    return cells.mapInArrow(lambda x: _columns(x, width), "contig string, pos long, ref string, depth long, bases string")

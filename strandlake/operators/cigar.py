"""CIGAR strings: operations, a walk over them, and merged insertions and deletions.

All are column expressions over one row's array, so a scan of alignments stays a projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDELS = "array<struct<pos:bigint,len:bigint>>"


def operations(cigar: Column) -> Column:
    """array<struct<n, op>>: counts and letters in order; `*` has none."""
    found = F.regexp_extract_all(F.coalesce(cigar, F.lit("*")), F.lit(r"(\d+)(\D)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).try_cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))


def walked(ops: Column, pos: Column, capture: int = 5, largest: int = 4_000_000) -> Column:
    """struct<ref, query, left, right, ins, dels> of operations from a start.

    M, = and X advance both; I advances the query; D, N and P the reference. A clip is the left one where it is the
    first operation, else the right one; the last right one counts. Indels of capture to largest bases are kept.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast(INDELS)
    start = F.struct(zero.alias("ref"), zero.alias("query"), zero.alias("left"), zero.alias("right"), zero.alias("k"), none.alias("ins"), none.alias("dels"))

    def step(s: Column, x: Column) -> Column:
        n, op = x["n"], x["op"]
        here = F.array(F.struct((pos + s["ref"]).alias("pos"), n.alias("len")))
        kept = n.between(capture, largest)
        clip = op.isin("S", "H")
        return F.struct(
            (s["ref"] + F.when(op.isin("M", "=", "X", "D", "N", "P"), n).otherwise(0)).alias("ref"),
            (s["query"] + F.when(op.isin("M", "=", "X", "I"), n).otherwise(0)).alias("query"),
            F.when(clip & (s["k"] == 0), n).otherwise(s["left"]).alias("left"),
            F.when(clip & (s["k"] > 0), n).otherwise(s["right"]).alias("right"),
            (s["k"] + 1).alias("k"),
            F.when((op == "I") & kept, F.concat(s["ins"], here)).otherwise(s["ins"]).alias("ins"),
            F.when((op == "D") & kept, F.concat(s["dels"], here)).otherwise(s["dels"]).alias("dels"),
        )

    return F.aggregate(ops, start, step)


def merged_deletions(dels: Column, gap: int = 500) -> Column:
    """Runs of deletions whose gaps are at most `gap`: first position, summed length."""
    start = F.struct(F.array().cast(INDELS).alias("out"), F.lit(None).cast("long").alias("end"))

    def step(s: Column, x: Column) -> Column:
        last = F.try_element_at(s["out"], F.lit(-1))
        joined = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.struct(last["pos"].alias("pos"), (last["len"] + x["len"]).alias("len"))))
        near = F.coalesce(x["pos"] - s["end"] <= gap, F.lit(False))
        return F.struct(F.when(near & (F.size(s["out"]) > 0), joined).otherwise(F.concat(s["out"], F.array(x))).alias("out"), (x["pos"] + x["len"]).alias("end"))

    return F.aggregate(dels, start, step, lambda s: s["out"])


def merged_insertions(ins: Column) -> Column:
    """Insertions joined from the right: each takes the ones after it while they are near, and a sum may open a wider
    window. The state is what is joined so far, from the left."""
    none = F.array().cast(INDELS)

    def add(done: Column, x: Column) -> Column:
        def join(s: Column, y: Column) -> Column:
            most = F.greatest(s["own"]["len"], y["len"])
            near = s["open"] & (y["pos"] - s["own"]["pos"] <= F.when(most.between(100, 499), 400).otherwise(600))
            sum_of = F.struct(s["own"]["pos"].alias("pos"), (s["own"]["len"] + y["len"]).alias("len"))
            rest = F.when(near, s["rest"]).otherwise(F.concat(s["rest"], F.array(y)))
            return F.struct(F.when(near, sum_of).otherwise(s["own"]).alias("own"), rest.alias("rest"), near.alias("open"))

        return F.aggregate(done, F.struct(x.alias("own"), none.alias("rest"), F.lit(True).alias("open")), join, lambda s: F.concat(F.array(s["own"]), s["rest"]))

    return F.when(F.size(ins) > 1, F.aggregate(F.reverse(ins), none, add)).otherwise(ins)


def with_cigar(alignments: DataFrame, min_size: int = 50, largest: int = 4_000_000) -> DataFrame:
    """alignments with ref_len, query_len, left_clip, right_clip, insertions and deletions (merged, at least min_size)."""
    out = alignments.withColumn("_ops", operations(F.col("cigar"))).withColumn("_w", walked(F.col("_ops"), F.col("pos"), largest=largest))
    long = lambda a: F.filter(a, lambda x: x["len"] >= min_size)
    return out.select(
        *alignments.columns,
        F.col("_w.ref").alias("ref_len"), F.col("_w.query").alias("query_len"), F.col("_w.left").alias("left_clip"), F.col("_w.right").alias("right_clip"),
        long(merged_insertions(F.col("_w.ins"))).alias("insertions"),
        long(merged_deletions(F.col("_w.dels"))).alias("deletions"),
    )

"""Column functions on sequences, read lists, pileups and sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCATGCA"))


def sorted_reads(reads: Column) -> Column:
    """Distinct non-empty names of a read array, in order."""
    return F.array_sort(F.array_distinct(F.filter(reads, lambda x: x != "")))


def union_size(a: Column, b: Column) -> Column:
    return F.size(F.array_union(F.filter(a, lambda x: x != ""), F.filter(b, lambda x: x != ""))).cast("long")


def normalized_pileup(bases: Column) -> Column:
    """Without read starts; reverse-strand symbols as forward ones."""
    return F.translate(F.regexp_replace(bases, r"\^.", ""), ",acgt", ".ACGT")


def occurrences(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def indel_sequences(bases: Column, marker: str) -> Column:
    """Sequences after marker and a length, of that length (or what is left). A marker without a length is skipped."""
    parts = F.split(bases, f"[{marker}]")
    tails = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    sized = F.filter(tails, lambda p: p.rlike(r"^\d"))
    digits = lambda p: F.regexp_extract(p, r"^\d+", 0)
    return F.transform(sized, lambda p: F.substr(p, F.length(digits(p)) + 1, digits(p).cast("int")))


def most_frequent(values: Column) -> Column:
    """The most frequent element, of ties the first seen; null of an empty array.

    Sorted, equal elements stand together: one walk over them counts each and keeps the best so far."""
    places = F.array_sort(F.transform(values, lambda x, k: F.struct(x.alias("value"), k.alias("at"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("value"))
    better = lambda new, old: (new["n"] > old["n"]) | ((new["n"] == old["n"]) & (new["at"] < old["at"]))

    def step(s: Column, x: Column) -> Column:
        again = s["now"]["value"].eqNullSafe(x["value"]) & (s["now"]["n"] > 0)
        now = F.struct(F.when(again, s["now"]["n"] + 1).otherwise(1).alias("n"), F.when(again, s["now"]["at"]).otherwise(x["at"]).alias("at"), x["value"].alias("value"))
        return F.struct(now.alias("now"), F.when(better(now, s["best"]), now).otherwise(s["best"]).alias("best"))

    return F.aggregate(places, F.struct(none.alias("now"), none.alias("best")), step, lambda s: s["best"]["value"])


def human_size(n: Column) -> Column:
    """Bytes by powers of 1024, up to TB, with two decimals."""
    n = n.cast("double")
    return (
        F.when(n < 1024, F.format_string("%.2f B", n)).when(n < 1024**2, F.format_string("%.2f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.2f MB", n / 1024**2)).when(n < 1024**4, F.format_string("%.2f GB", n / 1024**3))
        .otherwise(F.format_string("%.2f TB", n / 1024**4))
    )


#: The factorials of 0 to 15, and the first terms of Stirling's series for ln n! beyond.
FACTORIALS = [math.factorial(k) for k in range(16)]
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def ln_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    series = sum((F.lit(c) / x ** (2 * k + 1) for k, c in enumerate(STIRLING)), F.lit(0.0))
    small = F.ln(F.get(F.array(*[F.lit(float(f)) for f in FACTORIALS]), n.cast("int")))
    return F.when(n < len(FACTORIALS), small).otherwise((x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X > max(k - 1, 0)) of a binomial: one minus its distribution function. 0 where that is certain.

    Of the two sides of k the one beyond the mode is summed, from its largest term on: that term by logarithms, as
    it may be too small for a product, the others by their ratio to the one before."""
    last = F.greatest(k - 1, F.lit(0)).cast("long")
    q = 1 - p
    term = lambda i: F.exp(ln_factorial(n) - ln_factorial(i) - ln_factorial(n - i) + i * math.log(p) + (n - i) * math.log(q))
    begin = lambda t: F.struct(t.alias("term"), t.alias("sum"))
    grown = lambda s, ratio: F.struct((s["term"] * ratio).alias("term"), (s["sum"] + s["term"] * ratio).alias("sum"))
    above = F.aggregate(F.filter(F.sequence(last, n - 1), lambda i: i > last), begin(term(last + 1)), lambda s, i: grown(s, (n - i) / (i + 1) * (p / q)), lambda s: s["sum"])
    below = F.aggregate(F.when(last > 0, F.sequence(last, F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>")), begin(term(last)), lambda s, i: grown(s, i / (n - i + 1) * (q / p)), lambda s: s["sum"])
    tail = F.when(last + 1 >= (n + 1) * p, above).otherwise(1 - below)
    return F.when(last >= n, 0.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))

"""Quality rules: a decision list learned by sequential covering, applied as ordered conditional expressions.

Everything runs as DataFrame expressions. Each text becomes a row of counts (words, symbols, repeated lines, words in
repeated 3-word windows), and the counts become ratios. Learning reads labelled ratios only: they are cut at quantiles,
counted by cell once, and every step of growing or pruning a rule is one aggregation of that table of counts. What
reaches the driver is a table of (feature, cut) counts, whose size doesn't depend on the data.

Rules and their conditions are as many as the labels support: growing ends without gain, learning ends with the first
rule that isn't precise enough. A rule is pruned by its share of bad rows less that of good ones on the pruning rows, and
judged by its smoothed precision on all labelled rows and by none of the pruning rows speaking against it more than
that, so a faultless rule passes on few labels.

Defined results: a null text counts as empty; an empty text has no words and fails the base rules; repeated and tied rows
are judged alike; a text of any length is counted whole (its words and their hashes are in memory at a time); an empty
table gives an empty result, and without labels no rule is learned. Other columns of the input pass through (a column
with the name of a computed one is replaced; the stage returns all columns of its input, whatever their names).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, labels_of, stored, table, text_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that rules may test, by name.
RATIOS: dict[str, str] = {
    "f_words": "n_words",
    "f_word_length": "word_chars / greatest(n_words, 1)",
    "f_symbols": "n_symbols / greatest(n_words, 1)",
    "f_dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "f_repeats": "n_repeat_words / greatest(n_words, 1)",
    "f_short_words": "n_short_words / greatest(n_words, 1)",
    "f_line_words": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS, n_lines and n_short_words of each whole text.

    A window is found again where its 64-bit hash is: hashes and positions are packed, sorted, and compared with their
    neighbours, so a text of n words takes n log n steps and memory for n numbers.
    """
    out = docs.withColumns(
        {
            "_w": F.array_remove(F.split(text_of(text), SPACE), ""),
            "_l": F.filter(F.split(text_of(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count(text_of(text), F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_short_words": F.size(F.filter("_w", lambda x: F.length(x) <= 3)).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_b": F.length(F.bin(F.size("_w"))),
            "_h": F.expr("slice(transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2))), 1, greatest(size(_w) - 2, 0))"),
        }
    ).drop("_w", "_l")
    out = out.withColumn("_s", F.expr("sort_array(transform(_h, (x, i) -> shiftleft(x, _b) | i))"))
    again = (
        "get(_h, int(v & (shiftleft(1L, _b) - 1))) = get(_h, int(get(_s, k - 1) & (shiftleft(1L, _b) - 1)))"
        " OR get(_h, int(v & (shiftleft(1L, _b) - 1))) = get(_h, int(get(_s, k + 1) & (shiftleft(1L, _b) - 1)))"
    )
    near = "shiftright(v, _b) = shiftright(get(_s, k - 1), _b) OR shiftright(v, _b) = shiftright(get(_s, k + 1), _b)"
    out = out.withColumn("_p", F.expr(f"sort_array(transform(filter(_s, (v, k) -> ({near}) AND ({again})), v -> v & (shiftleft(1L, _b) - 1)))"))
    return out.withColumn(
        "n_repeat_words", F.expr("aggregate(transform(_p, (x, k) -> least(3L, x - coalesce(get(_p, k - 1), x - 3L))), 0L, (a, x) -> a + x)")
    ).drop("_b", "_h", "_s", "_p")


def with_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns({k: F.expr(v).cast("double") for k, v in RATIOS.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(labelled: DataFrame, *, n_cuts: int = 32, min_covered: int = 2, min_precision: float = 0.9) -> list[Rule]:
    """Rules for label 0, in order, from rows of RATIOS, label and grow (whether a row is for growing or pruning).

    A rule is grown one threshold at a time by information gain, cut back to the prefix that does best on the pruning
    rows, and accepted if it is precise enough; then what it covers is taken out."""
    names = list(RATIOS)
    at = [(k + 0.5) / n_cuts for k in range(n_cuts)]
    found = labelled.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in names]).first()
    cuts = {c: sorted(set(found[c] or [])) for c in names}
    if not any(cuts.values()):
        return []
    cells = labelled.select(
        "grow",
        (F.col("label") == 0).cast("long").alias("bad"),
        *[sum(((F.col(c) > x).cast("int") for x in cuts[c]), F.lit(0)).alias(c) for c in names],
    )
    cells = stored(
        cells.groupBy("grow", *names).agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")),
        "quality-cells",
    )
    rules: list[list[tuple[str, bool, int]]] = []

    def holds(rule) -> Column:
        out = F.lit(True)
        for name, above, k in rule:
            out = out & (F.col(name) > k if above else F.col(name) <= k)
        return out

    while True:
        left = cells
        for r in rules:
            left = left.where(~holds(r))
        rule: list[tuple[str, bool, int]] = []
        while True:
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("cell")) for c in names])).alias("x")
            rows = left.where("grow").where(holds(rule)).select(pairs, "bad", "good").groupBy("x.name", "x.cell").agg(F.sum("bad"), F.sum("good")).collect()
            best = best_threshold(rows, cuts, min_covered)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        sums = [F.sum(F.when(holds(rule[:k]) & side, F.col(c)).otherwise(0)) for k in range(1, len(rule) + 1) for side in (F.col("grow"), ~F.col("grow")) for c in ("bad", "good")]
        row = [x or 0 for x in left.agg(*sums).first()]
        length = accepted([tuple(row[4 * k : 4 * k + 4]) for k in range(len(rule))], min_precision)
        if not length:
            break
        rules.append(rule[:length])
    return [tuple(Condition(c, above, cuts[c][k]) for c, above, k in rule) for rule in rules]


def accepted(counts: list[tuple[int, int, int, int]], min_precision: float) -> int:
    """How many conditions of a rule to keep, 0 to refuse it. counts: for each prefix, bad and good growing rows, then bad
    and good pruning rows."""
    value = lambda x: round((x[2] - x[3]) / max(1, x[2] + x[3]), 3)
    k = max(range(len(counts)), key=lambda k: (value(counts[k]), counts[k][2], -k))
    bad, good, p, n = counts[k]
    precise = (bad + p + 1) / (bad + p + good + n + 2) >= min_precision
    return k + 1 if precise and p > 0 and p >= min_precision * (p + n) else 0


def best_threshold(rows, cuts, min_covered) -> tuple[str, bool, int] | None:
    """The threshold (feature, above, cell) with the most information gain for rows (feature, cell, bad, good), or None."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for name, cell, bad, good in rows:
        by.setdefault(name, {})[cell] = (bad, good)
    best, most = None, 1e-9
    for name, cells in sorted(by.items()):
        all_bad, all_good = (sum(x[i] for x in cells.values()) for i in (0, 1))
        if not all_bad or not all_good:
            continue
        prior = math.log2(all_bad / (all_bad + all_good))
        low_bad = low_good = 0
        for k in range(len(cuts[name])):  # cell k or below: value <= cuts[k]
            bad, good = cells.get(k, (0, 0))
            low_bad, low_good = low_bad + bad, low_good + good
            for above, p, n in ((False, low_bad, low_good), (True, all_bad - low_bad, all_good - low_good)):
                if p >= min_covered:
                    gain = p * (math.log2(p / (p + n)) - prior)
                    if gain > most + 1e-9:
                        best, most = (name, above, k), gain
    return best


def rule_number(rules: list[Rule]) -> Column:
    """The first rule that holds, from 1, else 0: one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        all_hold = F.lit(True)
        for c in rule:
            all_hold = all_hold & c.column()
        out = F.when(all_hold, k) if out is None else out.when(all_hold, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(counts: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """Rules learned from counts (with doc_id) and labels.quality. A third of the rows, by hash, is for pruning.

    counts are stored rows: a filter on counts that are still expressions would make them many times over."""
    some = counts.select("doc_id", *COUNTS, "n_lines", "n_short_words").where(~base_failed())
    labelled = with_ratios(some.join(labels_of(labels, "quality"), "doc_id"))
    labelled = labelled.select(*RATIOS, "label", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"))
    return learn(stored(labelled, "quality-labelled"), **options)


def judge(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """counts with base_failed, rule (0: none holds) and kept."""
    out = with_ratios(counts).withColumns({"base_failed": base_failed(), "rule": rule_number(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop(*RATIOS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = stored(with_counts(docs).drop("text"), "quality-counts")
    rules = fit(counts, table(spark, sf_dir, "labels"))
    return judge(counts, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the base rules and the learned rules keep; odd rows as the module defines. The counts are made once and stored beside the rows, so
    learning reads a few slim columns and no text is shuffled."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    counted = stored(with_counts(rows).drop("text"), "quality-counted")
    rules = fit(counted.drop("row"), table(spark, sf_dir, "labels"))
    return judge(counted, rules).where("kept").select("row.*")


QUERIES = {"op6_quality_rules": op6_quality_rules}

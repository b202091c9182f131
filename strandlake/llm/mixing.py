"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and lined up, and the line is gone through up to `most` times. A document
is queued in packets of at most `packet` words; a packet's virtual finish time is the number of its source's words up to
its end, divided by the source's target. All packets are served in order of finish time, whatever their source, until
the total budget is reached, where the packet on the edge is cut. As a source's line moves by its target in a unit of
virtual time, each source then has its target but for about a packet.

The order is global and nothing is sorted whole: ranges of finish time (which hold about as many words each, as served
words follow virtual time) are summed, the sums are run through to find the one range that holds the edge, and only the
packets of that range are put in order. The running sum of a source's line is made in two steps as well, over ranges of
the hash (about `run` rows each) and within a range, so no task holds a source. Windows without keys run over one row a
source, or one row a range.

Defined results: a null text has size 0, and a document of size 0 takes 0; a null source is a source of its own, ordered
last; the line is ordered by a hash of id and text, so tied and null ids are spread, and rows that are equal in both stand
beside each other, as one entry until the end; a text of any length is queued in packets; further columns, of any name,
pass through the stage and aren't read by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, stored, table, text_of

#: Copies of a document at most, and words of a packet.
MOST, PACKET = 3, 64


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def line_key(seed: int = 0) -> Column:
    """The place in line: a hash of id and text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_of())))


def sizes_of(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, key and size of docs (doc_id, text, source)."""
    return docs.select("doc_id", "source", line_key(seed).alias("key"), n_words().alias("size"))


def source_targets(sizes: DataFrame, budget: int | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """One row a source: source_size, n_rows, target, and the budget of all. Sources by code point, null last, weigh
    `weights`, repeating.

    A target is weight * level, at most `most` times the source's size; the level is the one at which the targets sum to
    the budget (all sizes if None). In order of most * size / weight, it is the first level that its source can take.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name, by_room = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("room", "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("place", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    per = per.withColumns({"full": most * F.col("source_size"), "room": (most * F.col("source_size")).cast("double") / F.col("weight")})
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) if budget is None else F.least(F.lit(budget).cast("long"), F.sum("full").over(everything))
    left = (total - F.coalesce(F.sum("full").over(before), F.lit(0))).cast("double")
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumns({"level": left / weight_left, "budget": total})
    per = per.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(everything)["level"], F.lit(float("inf"))))
    return per.select("source", "place", "source_size", "n_rows", "budget", F.least(F.col("full").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def lined(sizes: DataFrame, targets: DataFrame, run: int = 10_000) -> DataFrame:
    """sizes and targets as a line for each source: of rows that are equal one, with n and start, the words of its source
    before it."""
    groups = sizes.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    at = F.conv(F.substring("key", 1, 12), 16, 10).cast("long")
    rows = groups.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("d.*", "t.place", "t.source_size", "t.target", F.floor(at * F.ceil(F.col("n_rows") / run) / F.lit(2.0**48)).alias("range"))
    words = F.col("size") * F.col("n")
    ranges = rows.groupBy("place", "range").agg(F.sum(words).alias("sum"))
    ranges = ranges.select("place", "range", (F.sum("sum").over(Window.partitionBy("place").orderBy("range")) - F.col("sum")).alias("before"))
    line = Window.partitionBy("place", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum(words).over(line) - words).join(ranges, ["place", "range"])
    return rows.withColumn("start", F.col("before") + F.col("inside")).drop("range", "before", "inside")


def packets(entries: DataFrame, most: int, packet: int) -> DataFrame:
    """place, start, copy, first (word of the copy), words and finish of all packets of entries."""
    rows = entries.where("size > 0").select("place", "start", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))).alias("first"))
    rows = rows.withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("first")))
    finish = (F.col("copy") * F.col("source_size") + F.col("start") + F.col("first") + F.col("words")) / F.col("target")
    return rows.select("place", "start", "copy", "first", "words", finish.alias("finish"))


def served(entries: DataFrame, budget: int, most: int = MOST, packet: int = PACKET, run: int = 10_000) -> DataFrame:
    """place, start, copy and words: what the mix takes of each copy of entries (place, start, size, source_size, target),
    where it takes any."""
    steps = budget // packet // run + 1
    # All is served at about time 1: what is not by 2 needs no ranges.
    queue = packets(entries, most, packet).withColumn("range", F.floor(F.least("finish", F.lit(2.0)) * steps))
    sums = queue.groupBy("range").agg(F.sum("words").alias("sum"))
    sums = sums.withColumn("before", F.sum("sum").over(Window.orderBy("range")) - F.col("sum"))
    edge = sums.where(F.col("before") + F.col("sum") >= budget).orderBy("range").first()
    at, before = (edge["range"], edge["before"]) if edge else (2 * steps + 1, 0)
    order = Window.orderBy("finish", "place", "copy", "start", "first").rowsBetween(Window.unboundedPreceding, 0)
    last = queue.where(F.col("range") == at)
    last = last.withColumn("words", F.least("words", F.lit(budget - before) - F.sum("words").over(order) + F.col("words"))).where("words > 0")
    whole = queue.where(F.col("range") < at)
    return whole.unionByName(last).groupBy("place", "start", "copy").agg(F.sum("words").alias("words"))


def mixed(docs: DataFrame, most: int = MOST, **options) -> DataFrame:
    """One row for each of docs (doc_id, text, source): doc_id, source, key, n, nth (of n equal rows), size, source_size,
    target, start, finish (of its first copy), and served: the words taken of each copy."""
    sizes = stored(sizes_of(docs), "mix-sizes")
    targets = stored(source_targets(sizes, most=most), "mix-targets")
    budget = (targets.agg(F.max("budget")).first()[0]) or 0
    line = lined(sizes, targets).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    line = stored(line.withColumn("start", F.col("start") + F.col("nth") * F.col("size")), "mix-line")
    found = served(line, budget, most, **options).groupBy("place", "start").agg(*[F.sum(F.when(F.col("copy") == k, F.col("words"))).alias(f"copy{k}") for k in range(most)])
    # A document without words shares its start with the next one.
    found = found.withColumnRenamed("place", "_place").withColumnRenamed("start", "_start")
    out = line.join(found, (F.col("place") == F.col("_place")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    copies = F.array(*[F.coalesce(f"copy{k}", F.lit(0).cast("long")) for k in range(most)])
    out = out.withColumns({"served": copies, "finish": F.try_divide(F.col("start") + F.col("size"), F.col("target"))})
    return out.select("doc_id", "source", "key", "n", "nth", "size", "source_size", "target", "start", "finish", "served")


def first_words(n: Column, text: str = "text") -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text_of(text), F.lit(f"(?:{SPACE})?{WORD}"), 0), F.lit(1), n.cast("int")), "")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.orderBy("finish", "key", "nth").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of docs, range-sorted by virtual finish time: a document stands as often as it is taken, and where it is
    taken in part, with the words taken. Nulls, ties, repeated rows, long texts and further columns: as the module defines."""
    in_line = lambda key: F.concat_ws(":", key, F.col("source"))
    mix = mixed(docs.select("doc_id", "text", "source")).withColumn("line", in_line(F.col("key")))
    mix = stored(mix.select("line", "n", "nth", "key", "size", "source_size", "target", "start", "served"), "mix-served")
    rows = docs.select(F.struct("*").alias("row"), in_line(line_key()).alias("line"))
    # Where rows are equal by id, text and source, each takes one of their places; all others join their only one.
    once = rows.join(mix.where("nth = 0"), "line")
    again = once.where("n > 1").select("row", "line", (F.row_number().over(Window.partitionBy("line").orderBy(F.lit(0))) - 1).cast("long").alias("nth"))
    every = once.where("n = 1").unionByName(again.join(mix, ["line", "nth"]))
    every = every.select("*", F.posexplode("served").alias("copy", "words")).where("words > 0")
    cut, changed = F.col("words") < F.col("size"), F.col("row").withField("text", first_words(F.col("words"), "row.text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(first_words(F.col("words"), "row.text")).cast(docs.schema["n_chars"].dataType))
    finish = (F.col("copy") * F.col("source_size") + F.col("start") + F.col("size")) / F.col("target")
    every = every.select(F.when(cut, changed).otherwise(F.col("row")).alias("row"), finish.alias("finish"), "key", "nth", "copy")
    return every.orderBy("finish", "key", "nth", "copy").select("row.*")


ORACLE_SQL = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, 1 + place % 3 AS weight, 3 * source_size AS full_size, CAST(3 * source_size AS DOUBLE) / (1 + place % 3) AS room FROM p),
v AS (SELECT *, CAST((SELECT sum(source_size) FROM p) - coalesce(sum(full_size) OVER b, 0) AS DOUBLE)
    / CAST((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, place, source_size, least(CAST(full_size AS DOUBLE), weight * (SELECT level FROM v WHERE level <= room ORDER BY room, place LIMIT 1)) AS target FROM v),
l AS (SELECT d.*, t.place, t.source_size, t.target, row_number() OVER () AS n,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT l.n, l.place, l.start, copy, "first", least(64, size - "first") AS words,
    CAST(copy * source_size + start + "first" + least(64, size - "first") AS DOUBLE) / target AS finish
  FROM l, unnest([0, 1, 2]) AS c(copy), unnest(range(0, size, 64)) AS f("first") WHERE size > 0),
s AS (SELECT n, least(words, (SELECT sum(size) FROM d) - CAST(sum(words) OVER (ORDER BY finish, place, copy, start, "first" ROWS UNBOUNDED PRECEDING) AS BIGINT) + words) AS words FROM q),
k AS (SELECT n, CAST(sum(words) AS BIGINT) AS taken FROM s WHERE words > 0 GROUP BY n)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM l LEFT JOIN k USING (n)"""
}
QUERIES = {"op4_mixing": op4_mixing}

"""Phrases that stand together more often than their parts: suffix-sigma counts and a cut score.

Every word starts a suffix: itself and up to `most - 1` words behind it in its piece. Equal suffixes of a chunk of text are
summed first; then the suffixes are shuffled by language and first word, in ranges of their order, so that one frequent first
word is dealt to as many tasks as its suffixes fill. Where the ranges are cut follows from a sample of texts; it decides
nothing but the sizes of tasks. What a chunk sends to a range is one row: a sorted run of suffixes. A task sorts its suffixes in
reverse, so that all that share a prefix stand together, and counts every prefix with one stack: a prefix leaves it when a
suffix without it comes. A prefix at an edge of a range may go on in the next one: such parts are summed afterwards, all
others are whole. A task has one Python worker at a time, which holds a batch as it came and what one chunk needs.

Defined results: a null text has no words, a null language is `und`; an empty table gives no rows; repeated rows and ids
count each time (ids aren't read); further columns, of any name, aren't read; a text of any length is counted whole, one piece of a
text (between two separators) being the least that a task holds; phrases that tie in all else are ranked by their bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, stored, table, text_of
from .tokens import Numbers

#: Lower-cases A-Z; every separator of pieces becomes a full stop, a tab a space.
CUT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
#: What stands between the fields of a key, and behind its last; no word has it.
END = " "
#: Signs of a language's name that a key can't have, and how they are written in it.
ESCAPES = (("%", "%25"), (END, "%20"), ("\n", "%0A"))


def _chunks(texts: Iterable[bytes], size: int) -> Iterator[bytes]:
    """The texts, with CUT applied, joined to chunks of about `size` bytes; longer ones are cut between pieces."""
    held, n = [], 0
    for text in texts:
        text, at = text.translate(CUT), 0
        while at <= len(text):
            end = text.find(b".", at + size)
            end = len(text) if end < 0 else end
            held.append(text[at:end])
            n, at = n + end - at, end + 1
            if n >= size:
                yield b".".join(held)
                held, n = [], 0
    if held:
        yield b".".join(held)


def _suffix_counts(lang: bytes, chunk: bytes, most: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct suffixes of a chunk, in order, and how often each comes: the language and the words, each with END, and a
    line break (which doesn't count for the order)."""
    words = chunk.replace(b".", b" . ").split()
    numbers = Numbers({b".": 0})
    n = len(words)
    met = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    del words
    terms = sorted(w + b" " for w in list(numbers)[1:])
    for k, w in enumerate(terms, 1):
        numbers[w[:-1]] = k
    ids = np.zeros(n + most, np.int64)
    ids[:n] = np.fromiter(numbers.values(), np.int64, len(numbers))[met]  # now in the order of the words
    code, span, own, columns = ids[:n], len(numbers), ids[:n], []
    for k in range(1, most):
        own = np.where(own > 0, ids[k : n + k], 0)
        columns.append(own)
        if span * len(numbers) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            span = n
        code, span = code * len(numbers) + own, span * len(numbers)
    begins = np.flatnonzero(ids[:n])
    _, first, counts = np.unique(code[begins], return_index=True, return_counts=True)
    at = begins[first]
    terms = pa.array([b"", *terms], pa.binary())
    ends = pa.scalar(b"\n", pa.binary())
    key = pc.binary_join_element_wise(pa.scalar(lang + b" ", pa.binary()), terms.take(pa.array(ids[at])), *(terms.take(pa.array(c[at])) for c in columns), ends, pa.scalar(b"", pa.binary()))
    return key, counts


def _of_chunks(batches: Iterator[pa.RecordBatch], most: int, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The suffixes of batches of (lang, text), a chunk of one language at a time; a text is taken from its batch when its
    chunk is made."""
    for batch in batches:
        rows, texts = defaultdict(list), batch.column(1)
        for k, lang in enumerate(batch.column(0)):
            rows[lang.as_py()].append(k)
        for lang, own in rows.items():
            for chunk in _chunks((texts[k].as_py() for k in own), size):
                yield _suffix_counts(lang, chunk, most)


def _texts(docs: DataFrame) -> DataFrame:
    """lang, with its spaces written otherwise, and text, as bytes."""
    lang = F.coalesce("lang", F.lit("und"))
    for sign, code in ESCAPES:
        lang = F.replace(lang, F.lit(sign), F.lit(code))
    return docs.select(lang.cast("binary").alias("lang"), text_of().cast("binary").alias("text"))


def range_ends(docs: DataFrame, most: int, size: int, rows: int, sample: int = 2000) -> list[bytes]:
    """Suffixes that cut the order of all suffixes into ranges of about `rows` distinct ones a chunk, by a sample of about
    `sample` texts, of each chunk of which up to 64 suffixes come to the driver."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _ in _of_chunks(batches, most, size):
            at = np.linspace(0, len(key) - 1, min(64, len(key))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(at)), pa.array(np.full(len(at), len(key) / max(len(at), 1)))], ["key", "weight"])

    every = max(docs.count() / sample, 1.0)
    found = _texts(docs).where(F.rand(1) < 1 / every).mapInArrow(lean(some), "key binary, weight double").collect()
    found = sorted((bytes(r.key[:-1]), r.weight) for r in found)
    upto = np.cumsum([w for _, w in found])
    n = int(upto[-1] * every / rows) + 1 if found else 1
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n) if found else []
    return sorted({found[k][0] for k in cuts})


def suffix_runs(docs: DataFrame, ends: list[bytes], most: int = 4, size: int = 1_000_000) -> DataFrame:
    """part, keys, n: for each chunk of `size` bytes and each range, a run of its suffixes (lines) and their numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, counts in _of_chunks(batches, most, size):
            at = [bisect_left(range(len(key)), e, key=lambda k, key=key: key[k].as_py()[:-1]) for e in ends]
            runs = [(p, b, e) for p, (b, e) in enumerate(zip([0, *at], [*at, len(key)], strict=True)) if b < e]
            if runs:
                edges = np.array([runs[0][1], *(r[2] for r in runs)], np.int32)
                offsets = np.frombuffer(key.buffers()[1], np.int32)[key.offset :][edges]
                keys = pa.Array.from_buffers(pa.string(), len(runs), [None, pa.py_buffer(offsets), key.buffers()[2]])
                n = pa.ListArray.from_arrays(pa.array(edges), pa.array(counts.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), keys, n], ["part", "keys", "n"])

    return _texts(docs).mapInArrow(lean(cut), "part int, keys string, n array<int>")


def suffixes(docs: DataFrame, most: int = 4, size: int = 1_000_000, rows: int = 1_000_000) -> DataFrame:
    """key, n: the suffixes of all texts of docs (text, lang), equal ones of a chunk summed; a range of them a partition, sorted
    in reverse."""
    ends = range_ends(docs, most, size, rows)
    runs = suffix_runs(docs, ends, most, size).repartitionById(len(ends) + 1, "part")
    # behind the last line's break there is nothing, which has no number
    lines = runs.select(F.inline(F.arrays_zip(F.split("keys", "\n").alias("key"), F.col("n")))).where("n IS NOT NULL")
    return lines.select("key", F.col("n").cast("long").alias("n")).sortWithinPartitions(F.desc("key"))


class Stack:
    """The prefixes of the suffix that was read last, each with its count. Suffixes come in reverse order."""

    def __init__(self, least: int):
        self.least, self.open, self.begun = least, [], False  # open: [word, count, whether it began the range] by depth

    def _leave(self, depth: int) -> Iterator[tuple[str, int]]:
        """Prefixes deeper than depth leave; those too rare are forgotten unless a part may lie in the range before."""
        for d in range(depth, len(self.open)):
            if self.open[d][1] >= self.least or self.open[d][2]:
                yield "".join(x[0] + END for x in self.open[: d + 1]), self.open[d][1]
        del self.open[depth:]

    def read(self, keys: pa.Array, n: np.ndarray) -> list[tuple[str, int]]:
        """Many suffixes at once; what left the stack, but rare ones."""
        words = pc.split_pattern(keys, END)
        begin = words.offsets.to_numpy().astype(np.int64)
        length = np.diff(begin) - 1  # there is nothing behind the last END
        codes = words.values.dictionary_encode().indices.to_numpy()
        deepest = int(length.max())
        at = begin[:-1, None] + np.arange(deepest)
        own = np.where(np.arange(deepest) < length[:, None], codes[np.minimum(at, len(codes) - 1)], -1)
        first, last = (keys[k].as_py().split(END)[:-1] for k in (0, len(keys) - 1))
        same = 0
        while same < min(len(first), len(self.open)) and self.open[same][0] == first[same]:
            same += 1
        out = list(self._leave(same))
        self.open += [[w, 0, not self.begun] for w in first[same:]]
        self.begun = True
        changed = np.zeros(len(n), bool)
        kept = []
        for d in range(deepest):
            changed[1:] |= own[1:, d] != own[:-1, d]
            starts = np.flatnonzero(changed & (own[:, d] >= 0))
            sums = np.diff(np.concatenate([[0], np.cumsum(np.where(own[:, d] >= 0, n, 0))])[np.concatenate([[0], starts, [len(n)]])])
            if d < len(self.open):
                self.open[d][1] += int(sums[0])
            ends_open = d < len(last)
            if ends_open:
                kept.append([last[d], int(sums[-1]), False] if len(starts) else self.open[d])
            whole = slice(1, len(sums) - 1 if ends_open else len(sums))
            for k in np.flatnonzero(sums[whole] >= self.least) + 1:
                out.append(("".join(w + END for w in keys[int(starts[k - 1])].as_py().split(END)[: d + 1]), int(sums[k])))
        gone = [d for d, x in enumerate(self.open) if d >= len(kept) or kept[d] is not x]
        for d in gone:
            if self.open[d][1] >= self.least or self.open[d][2]:
                out.append(("".join(x[0] + END for x in self.open[: d + 1]), self.open[d][1]))
        self.open = kept
        return out

    def end(self) -> list[tuple[str, int]]:
        """What is open at the range's end: all of it may have a part in the next range."""
        return [("".join(x[0] + END for x in self.open[: d + 1]), x[1]) for d, x in enumerate(self.open)]


def prefix_counts(suffix_rows: DataFrame, least: int) -> DataFrame:
    """key, f: every prefix of suffixes() (key, n) with the sum of n of those that begin with it, if at least `least`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(least)
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["key", "f"])
        for batch in batches:
            if batch.num_rows:
                yield as_batch(stack.read(batch.column(0), batch.column(1).to_numpy()))
        yield as_batch(stack.end())

    return suffix_rows.mapInArrow(lean(count), "key string, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrase_counts(docs: DataFrame, most: int = 4, least: int = 30) -> DataFrame:
    """lang, phrase, k (its words), f: phrases of 1 to `most` words with f >= least; phrase '' (k = 0) has all words of lang."""
    found = prefix_counts(suffixes(docs, most), least)
    lang, rest = F.substring_index("key", END, 1), F.expr("substring(key, instr(key, ' ') + 1)")
    name = lang
    for sign, code in reversed(ESCAPES):
        name = F.replace(name, F.lit(code), F.lit(sign))
    k = F.length("key") - F.length(F.replace("key", F.lit(END), F.lit(""))) - 1
    phrase = F.substring(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0)))
    return found.select(name.alias("lang"), phrase.alias("phrase"), k.alias("k"), "f")


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def scored(counts: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """lang, phrase, k, a, l, r, score of phrases of two words or more: the lowest of floor(scale * a / (l + r)) over the
    cuts of a phrase into a first part (l) and the rest (r); of equal ones that of the shortest first part."""
    parts = counts.where("k > 0")
    cuts = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    side = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    score = F.expr(f"CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    both = both.withColumn("score", score)
    least = both.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "k", "a", "x.l", "x.r", "x.score")


def without_parts(candidates: DataFrame, share: int = 80) -> DataFrame:
    """candidates but those that lie inside a longer one which comes at least `share` of a hundred times as often."""
    inner = F.expr("""flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), b ->
        concat_ws(' ', slice(split(phrase, ' ', -1), b, m)))))""")
    longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (100 * exact("longer") < share * exact("a"))).drop("longer")


def ranked(kept: DataFrame, best: int) -> DataFrame:
    """The `best` rows of each language with their rank: the place in a range of the order, and what the ranges before have of
    the language. No task gets all rows of a language; ranges behind the last one needed are left out before they are sorted."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = stored(kept.repartitionByRange("lang", *order).withColumn("part", F.spark_partition_id()), "phrase-ranges")
    before = F.sum("own").over(Window.partitionBy("lang").orderBy("part")) - F.col("own")
    ranges = rows.groupBy("lang", "part").agg(F.count("*").alias("own")).select("lang", "part", before.alias("before")).where(F.col("before") < best)
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    return rows.join(ranges, ["lang", "part"]).withColumn("rank", F.col("before") + place).where(F.col("rank") <= best).drop("part", "before")


def collocations(docs: DataFrame, most: int = 4, least: int = 30, best: int = 2000) -> DataFrame:
    """The `best` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = stored(phrase_counts(docs, most, least), "phrase-counts")
    kept = without_parts(scored(counts))
    top = ranked(kept, best)
    words = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
 g AS (SELECT lang, k, ws, unnest(range(1, CAST(len(ws) AS BIGINT)-k+2)) AS i FROM w, range(1, 5) t(k)),
 f AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
 n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
 u AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
 s AS (SELECT u.lang, u.k, u.phrase, a, cut, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT)*a//(CAST(x.f AS HUGEINT)+y.f) AS BIGINT) AS score FROM u
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[cut+1:], ' ')),
 c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 h AS (SELECT lang, a, array_to_string(string_split(phrase, ' ')[b:b+m-1], ' ') AS part FROM (SELECT *, unnest(range(1, k-m+2)) AS b FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)))
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, c.a DESC, phrase) AS rank, phrase, c.a, l, r, n, score FROM c JOIN n ON n.lang = c.lang
 WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = c.lang AND h.part = c.phrase AND CAST(100 AS HUGEINT)*h.a >= CAST(80 AS HUGEINT)*c.a) QUALIFY rank <= 2000"""

QUERIES = {"op13_phrases": op13_phrases}
ORACLE_SQL = {"op13_phrases": SQL}

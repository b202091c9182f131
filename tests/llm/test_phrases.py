"""Phrase counts and scores against plain loops, and the stack over any cuts of its rows."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, least, best, most=4):
    """rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    f = {x: a for x, a in f.items() if a >= least}
    own = {}
    for (lang, p), a in f.items():
        if len(p) > 1:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            own[lang, p] = (a, *min(cuts))
    gone = set()
    for (lang, p), (a, *_) in own.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                part = (lang, p[i : i + k])
                if 100 * a >= 80 * own[part][0]:
                    gone.add(part)
    out = []
    for lang in n:
        rows = sorted(((-s, -a, " ".join(p).encode(), left, r) for (g, p), (a, s, _, left, r) in own.items() if g == lang and (g, p) not in gone))
        out += [(lang, rank, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for rank, x in enumerate(rows[:best], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["A", "a", "b", "Bc", "été", "x\x01", "\x00", "don't", "%20", "zz"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rng.randrange(40)))
    return [(rng.choice(["en", "e n", "%20", "", None, "a\nb"]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize("size,rows", [(4_000_000, 2_000_000), (60, 20)])
def test_same_as_plain(spark, size, rows):
    """With one chunk and one range, and with chunks of a few words and a range for every twenty suffixes."""
    own = [*some_rows(1, 400), ("en", "one long line " * 3000), *[("en", "the same copy of a line")] * 200]
    docs = spark.createDataFrame([(t, g, 1) for g, t in own], "text string, lang string, phrase int").repartition(5)
    suffixes = phrases.suffixes(docs, 4, size, rows)
    parts = suffixes.rdd.getNumPartitions()
    assert parts == 1 if size > 100 else parts > 20
    counts = {(r.key.split(" ")[0], r.key) : r.f for r in phrases.prefix_counts(suffixes, 5).collect()}
    expected = Counter()
    for lang, text in own:
        lang = ("und" if lang is None else lang).replace("%", "%25").replace(" ", "%20").replace("\n", "%0A")
        for w in pieces(text):
            for i in range(len(w)):
                expected.update((lang, "".join(x + " " for x in [lang, *w[i : i + k]])) for k in range(min(4, len(w) - i) + 1))
    assert counts == {k: v for k, v in expected.items() if v >= 5}


def test_collocations(spark):
    own = [*some_rows(2, 600), ("en", "one long line " * 500), *[("en", "the same copy of a line")] * 40, *[(None, "the same copy of a line")] * 30]
    docs = spark.createDataFrame([(None, t, g) for g, t in own], "doc_id long, text string, lang string")
    assert found(phrases.collocations(docs)) == plain(own, 30, 2000)
    assert found(phrases.collocations(docs, least=4, best=7)) == plain(own, 4, 7)
    assert found(phrases.collocations(docs, most=3, least=3)) == plain(own, 3, 2000, most=3)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("text IS NULL OR text = ''")).count() == 0


def test_exact_beyond_64_bits(spark):
    big = 6 * 10**18
    counts = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, k int, f long")
    row = phrases.scored(counts).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1)
    cut = [("en", "a b c", 3, 8 * 10**16), ("en", "a b", 2, 10**17), ("en", "b c", 2, 10**17 + 1)]
    kept = phrases.without_parts(spark.createDataFrame(cut, "lang string, phrase string, k int, a long")).collect()
    assert {r.phrase for r in kept} == {"a b c", "b c"}


def test_stack_over_any_batches():
    rng = random.Random(3)
    rows = sorted({"".join(w + " " for w in ["en", *rng.choices(["a", "b", "c"], k=rng.randrange(1, 5))]) for _ in range(90)}, reverse=True)
    n = [rng.randrange(1, 9) for _ in rows]
    whole = Counter()
    for key, m in zip(rows, n):
        w = key.split(" ")[:-1]
        whole.update({"".join(x + " " for x in w[:k]): m for k in range(1, len(w) + 1)})
    for step in (1, 2, 7, 90):
        for edge in (0, 30, len(rows)):
            out = Counter()
            for part in (range(edge), range(edge, len(rows))):
                stack = phrases.Stack(12)
                for k in range(part.start, part.stop, step):
                    own = range(k, min(k + step, part.stop))
                    out.update(dict(stack.read(pa.array([rows[i] for i in own]), np.array([n[i] for i in own]))))
                out.update(dict(stack.end()))
            assert {k: v for k, v in out.items() if v >= 12} == {k: v for k, v in whole.items() if v >= 12}


def test_batch_is_not_copied():
    """Besides a batch, no more is held than a chunk needs."""
    batch = pa.RecordBatch.from_arrays([pa.array([b"en", b"de"] * 1000), pa.array([b"%d " % k * 2000 for k in range(2000)])], ["lang", "text"])
    tracemalloc.start()
    n = sum(int(counts.sum()) for _, counts in phrases._of_chunks(iter([batch]), 4, 50_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * 2000 and batch.nbytes > 17_000_000 and peak < 9_000_000


def test_one_worker_a_task(spark):
    """No stage has two steps in Python: each would have a worker of its own."""
    docs = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    plan = phrases.prefix_counts(phrases.suffixes(docs), 1)._jdf.queryExecution().executedPlan().toString()
    steps = [part.count("MapInArrow") for part in plan.split("Exchange")]
    assert sum(steps) == 2 and max(steps) == 1


def test_run_of_odd_words(spark):
    """Words with all signs but separators keep their lines and numbers when a run is opened."""
    signs = [chr(c) for c in [*range(1, 0x30), 0x7F, 0x85, 0xA0, 0x2028, 0x2029, 0xFEFF, 0x1F600] if chr(c) not in "\t\n\x0b\x0c\r .,!"]
    text = " ".join(f"{s} a{s} {s}{s}" for s in signs)
    rows = [("e\tn", text), ("", text), ("e\x85n", text), ("e\x85n", "")]
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string").repartition(2)
    assert found(phrases.collocations(docs, least=1)) == plain(rows, 1, 2000)


def test_ranks_by_ranges(spark):
    """Ranks over ranges of the order are those of a plain sort, ties included, and no window has a whole language's rows."""
    rng = random.Random(4)
    rows = [(lang, f"{c} {k}", rng.randrange(9), rng.choice([5, 5, 5, rng.randrange(400)])) for lang, n in (("en", 3000), ("e\tn", 1), ("", 40)) for k in range(n) for c in "aé"]
    kept = spark.createDataFrame(rows, "lang string, phrase string, a long, score long").repartition(3)
    for best in (1, 39, 2000, 9000):
        expected = []
        for lang in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1].encode()))
            expected += [(*r, k) for k, r in enumerate(own[:best], 1)]
        assert sorted(map(tuple, phrases.ranked(kept, best).collect())) == sorted(expected)
    docs = spark.createDataFrame([("a b c", "en")] * 30, "text string, lang string")
    plan = phrases.collocations(docs)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"row_number\(\) windowspecdefinition\((.*?) (?:DESC|ASC)", plan)
    assert windows and all(re.match(r"lang#\d+, part#\d+, ", w) for w in windows)

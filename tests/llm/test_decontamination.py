"""Benchmark hits and longest matches against plain loops; the suffix arrays against sorting."""

import random
import re

import numpy as np
import pytest

from strandlake.llm import decontamination as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(text, items, window):
    """n_words, n_hit, items, spans, the length of the longest match of a window or more."""
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    names.add("" if name is None else str(name))
    spans, at = [], None
    for p in sorted(hit):
        if at is None or p > spans[-1][1]:
            spans.append([p, p])
            at = p
        spans[-1][1] = p + 1
    longest = 0
    for j in range(len(own)):
        for _, item in items:
            w = words(item)
            for i in range(len(w)):
                n = 0
                while i + n < len(w) and j + n < len(own) and w[i + n] == own[j + n]:
                    n += 1
                longest = max(longest, n if n >= min(window, len(w)) else 0)
    return len(own), len(hit), sorted(names, key=str.encode), [tuple(s) for s in spans], longest


def texts_and_items(seed, n, vocabulary, sizes):
    rng = random.Random(seed)
    line = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(k, " ".join(line(rng.choice(sizes)))) for k in range(25)]
    items += [(3, items[5][1]), (None, items[6][1] + " x"), (30, ""), (31, None), (32, "¡!,.")]
    texts = [None, "", "...", items[2][1], items[1][1].upper() + "-" + items[4][1]]
    for _ in range(n):
        w = line(rng.randrange(60))
        if rng.random() < 0.5:
            own = words(rng.choice(items)[1])
            b = rng.randrange(len(own) + 1)
            w[5:5] = own[b : b + rng.randrange(30)]
        texts.append("".join(x + rng.choice([" ", "\n", ", ", "'"]) for x in w))
    return texts, items


@pytest.mark.parametrize("shard,block,window", [(500_000, 2_000_000, 10), (40, 300, 4), (7, 60, 3)])
def test_same_as_plain(spark, shard, block, window):
    """One shard and one block, and shards and blocks of few words, so that most texts are cut."""
    texts, items = texts_and_items(window, 150, ["a", "b", "C", "d", "é", "7"] if window < 5 else [f"w{k}" for k in range(300)], (0, 1, 2, 5, 12, 30))
    texts += [" ".join(texts[5:40:7]), texts[3], texts[3]]
    docs = spark.createDataFrame([(k % 150, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_hit int").repartition(3, "doc_id")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = dc.leaks(docs, benchmark, ("doc_id", "text", "n_hit"), window, shard, block).collect()
    assert len(found) == len(texts)
    for r in found:
        own = plain(r.text, items, window)
        assert (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans], r.longest.n_words if r.longest else 0) == own
        if r.longest:
            at = words(r.text)[r.longest.doc_word : r.longest.doc_word + r.longest.n_words]
            of = [words(t)[r.longest.item_word :][: len(at)] for k, t in items if ("" if k is None else str(k)) == r.longest["item"]]
            assert at in of
    kept = dc.decontaminated(docs, benchmark, window, shard, block)
    assert kept.columns == docs.columns
    clean = sorted(map(repr, (r.text for r in found if not r.n_hit)))
    assert sorted(map(repr, (r.text for r in kept.collect()))) == clean


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    for own in (items.limit(0), spark.createDataFrame([(1, None), (2, " ")], "item_id long, text string")):
        assert [(r.n_words, r.n_hit, r["items"], r.longest) for r in dc.leaks(docs, own).orderBy("doc_id").collect()] == [(0, 0, [], None), (2, 0, [], None)]
        assert dc.decontaminated(docs, own).count() == 2
    assert dc.leaks(docs.limit(0), items).count() == 0
    assert dc.decontaminated(docs, items).collect()[0].doc_id is None


def test_long_text_and_long_item(spark):
    item = " ".join(f"v{k}" for k in range(4000))
    text = "pad " * 30_000 + item + " pad" * 30_000
    docs = spark.createDataFrame([(1, text), (2, "v0 " * 40_000)], "doc_id long, text string")
    one, two = dc.leaks(docs, spark.createDataFrame([(9, item), (10, "pad " * 11)], "item_id long, text string"), shard=5000).orderBy("doc_id").collect()
    assert (one.n_words, one.n_hit, one["items"], one.longest.n_words, one.longest.doc_word) == (64_000, 64_000, ["10", "9"], 4000, 30_000)
    assert (two.n_words, two.n_hit) == (40_000, 0)


def test_suffixes_are_sorted_and_searched():
    rng = np.random.default_rng(5)
    for top, depth, n in ((2, 9, 300), (5, 1, 50), (70_000, 6, 400), (1, 40, 200), (3, 5, 1)):
        ids = rng.integers(0, top + 1, n)
        ids[-1] = 0
        own = dc.Suffixes(ids, top, depth)
        of = lambda p, ids=ids, depth=depth: tuple(ids[p : p + depth])
        ends = lambda p, ids=ids: tuple(ids[p : p + list(ids[p:]).index(0) + 1])
        cut = [min(of(p), ends(p), key=len) for p in own.slots]
        assert cut == sorted(cut) and sorted(own.slots) == list(range(n))
        starts = np.flatnonzero(own.left > 0)[:40]
        lengths = np.minimum(own.left[starts], rng.integers(1, depth + 1, len(starts)))
        low, high = own.found(own.keys, starts, lengths)
        for s, m, b, e in zip(starts, lengths, low, high):
            assert sorted(own.slots[b:e]) == [p for p in range(n) if tuple(ids[p : p + m]) == tuple(ids[s : s + m])]
        best, at = own.longest(own, starts)
        assert (best == own.left[starts]).all() or depth < own.left.max()

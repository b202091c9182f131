"""Benchmark passages in training texts, by suffix arrays of the training data.

A task's documents are its shards: about `shard` words at a time are numbered and their suffixes sorted, as far as the
longest benchmark text reaches. Every suffix of the benchmark is then looked up in the shard by binary search: all places
at which its first `window` words stand are hits, and from each hit place the longest verbatim match with an item that hits
there follows by a second binary search, in the sorted suffixes of the benchmark. Documents don't leave their task, so
nothing is shuffled. The benchmark is cut into blocks of a bounded size, stored in the shared folder; a shard meets them one after
another, so a large benchmark costs time but no memory.

A word is a run of letters and digits of ASCII and of anything beyond it; A-Z is lower-cased. A window is `window`
consecutive words of an item; an item of fewer words, but at least one, is one window.

Defined results: a null or empty text has no words and no hits; items that share an id are one item; an item without id
counts as an item of the name ''; repeated rows are judged each; an empty benchmark hits nothing and an empty table gives no
rows; a long text is cut into shards that overlap by the longest item, so it is matched whole; `docs` may
have further columns of any name: a kept column named like a result is left out.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh_path, table, text_of
from .token_files import get, made, put
from .tokens import Numbers, _ranges

#: Lower-cases A-Z, makes every other sign of ASCII that isn't a letter or digit a space.
WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
RESULT = """n_words long, n_hit long, items array<string>, spans array<struct<from_word: long, to_word: long>>,
 longest struct<item: string, item_word: long, doc_word: long, n_words: long>"""
FIELDS = ("n_words", "n_hit", "items", "spans", "longest")
SPANS = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))
LONGEST = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])


class Suffixes:
    """The suffixes of a row of numbers, at most `top`, sorted by their first `depth` numbers; 0 ends a text. A search never
    goes past the end of a text, so suffixes that are equal up to there stay in any order."""

    def __init__(self, ids: np.ndarray, top: int, depth: int):
        self.n, self.depth, self.bits = len(ids), depth, max(int(top).bit_length(), 1)
        self.per = 63 // self.bits
        padded = np.concatenate([ids, np.zeros(depth + 2 * self.per, np.int64)])
        self.keys = np.zeros(self.n + depth + self.per, np.int64)  # so many numbers from each place on, packed
        for k in range(self.per):
            self.keys = self.keys << self.bits | padded[k : k + len(self.keys)]
        ends = np.flatnonzero(ids == 0)
        self.left = np.append(ends, self.n)[np.searchsorted(ends, np.arange(self.n))] - np.arange(self.n)  # to the end of the text
        self.slots = np.argsort(self.keys[: self.n], kind="stable")
        self._sort(depth)

    def _sort(self, depth: int) -> None:
        """Suffixes that are equal in their first h numbers are sorted by the rank of what comes h numbers later."""
        own = self.keys[self.slots]
        at = np.arange(self.n)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]])[: self.n], at, 0))
        rank = np.zeros(self.n + 1, np.int64)
        rank[self.slots] = first
        tied, h = at, self.per
        while h < depth:
            group = rank[self.slots[tied]]
            same = (group[1:] == group[:-1]) & (tied[1:] == tied[:-1] + 1)
            some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            tied = tied[some[: len(tied)] & (self.left[self.slots[tied]] >= h)]
            if not len(tied):
                return
            place = self.slots[tied]
            key = rank[place] * (self.n + 1) + rank[np.minimum(place + h, self.n)]
            order = np.argsort(key, kind="stable")
            place, key = place[order], key[order]
            self.slots[tied] = place
            begins = np.concatenate([[True], key[1:] != key[:-1]])
            rank[place] = np.maximum.accumulate(np.where(begins, tied, 0))
            h *= 2

    def _differs(self, slots: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: whether the suffix of each slot is less than, begins with, or is more than `lengths` numbers of the
        packed `keys` from `starts` on."""
        out, todo, done = np.zeros(len(slots), np.int8), np.arange(len(slots)), 0
        place = self.slots[slots]
        while len(todo):
            left = np.minimum(lengths[todo] - done, self.per)
            shift = self.bits * (self.per - left)
            one, two = self.keys[place[todo] + done] >> shift, keys[starts[todo] + done] >> shift
            out[todo] = np.where(one < two, -1, one > two)
            done += self.per
            todo = todo[(one == two) & (lengths[todo] > done)]
        return out

    def _search(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
        """The first slot from `low` on whose suffix differs by more than `most` (see _differs)."""
        low, high = low.copy(), np.full(len(starts), self.n)
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            below = self._differs(middle, keys, starts[todo], lengths[todo]) <= most
            low[todo[below]] = middle[below] + 1
            high[todo[~below]] = middle[~below]
            todo = todo[low[todo] < high[todo]]
        return low

    def found(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of slots whose suffixes begin with each query; empty ranges if none."""
        low = self._search(keys, starts, lengths, np.zeros(len(starts), np.int64), -1)
        high, hit = low.copy(), np.flatnonzero(low < self.n)
        hit = hit[self._differs(low[hit], keys, starts[hit], lengths[hit]) == 0]
        high[hit] = self._search(keys, starts[hit], lengths[hit], low[hit], 0)
        return low, high

    def common(self, slots: np.ndarray, other: Suffixes, starts: np.ndarray) -> np.ndarray:
        """How many numbers the suffix of each slot has in common with that of `other` at `starts`, within their texts."""
        place = self.slots[slots]
        most = np.minimum(self.left[place], other.left[starts])
        out, todo = np.zeros(len(slots), np.int64), np.arange(len(slots))
        while len(todo):
            one, two = self.keys[place[todo] + out[todo]], other.keys[starts[todo] + out[todo]]
            equal = sum((one >> s == two >> s).astype(np.int64) for s in (self.bits * np.arange(self.per)).tolist())
            out[todo] += equal
            todo = todo[(equal == self.per) & (out[todo] < most[todo])]
        return np.minimum(out, most)

    def longest(self, other: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest match of each suffix of `other` at `starts`: its length and a place of it here."""
        low = self._search(other.keys, starts, np.minimum(other.left[starts], self.depth), np.zeros(len(starts), np.int64), -1)
        best, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for slot in (low - 1, low):
            near = np.clip(slot, 0, self.n - 1)
            n = self.common(near, other, starts)
            place = np.where(n > best, self.slots[near], place)
            best = np.maximum(n, best)
        return best, place


def block_of(names: list[str], texts: list[bytes], window: int) -> bytes:
    """A block of the benchmark: its words, all items as numbers of words, and the distinct windows with their items."""
    words = [t.translate(WORDS).split() for t in texts]
    numbers = Numbers({b"": 0})
    ids = np.array([k for w in words for k in (*map(numbers.__getitem__, w), 0)], np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    item = np.repeat(np.arange(len(words)), sizes + 1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    own = Suffixes(ids, len(numbers), window)
    slots = np.flatnonzero(own.left[own.slots] >= window)
    # Suffixes in order: those that share their first words stand together.
    apart = np.ones(len(slots), bool)
    apart[1:] = (np.diff(slots) > 1) | (own.common(slots[1:], own, own.slots[slots[:-1]]) < window)
    kind, starts = np.cumsum(apart) - 1, own.slots[slots]
    short: dict = {}
    for k in np.flatnonzero((sizes > 0) & (sizes < window)).tolist():
        short.setdefault(tuple(words[k]), []).append(k)
    first = np.concatenate([starts[apart], np.array([begin[x[0]] for x in short.values()], np.int64)])
    length = np.concatenate([np.full(int(apart.sum()), window), np.array([len(w) for w in short], np.int64)])
    of = np.concatenate([kind, np.repeat(np.arange(len(short)) + apart.sum(), [len(x) for x in short.values()])]).astype(np.int64)
    items = np.concatenate([item[starts], np.array([k for x in short.values() for k in x], np.int64)]).astype(np.int64)
    pairs = np.unique(np.stack([of, items]), axis=1)
    data = {"names": names, "vocabulary": b" ".join(list(numbers)[1:]), "ids": ids, "item": item, "begin": begin, "first": first, "length": length,
            "upto": np.searchsorted(pairs[0], np.arange(len(first) + 1)), "items": pairs[1], "longest": int(sizes.max(initial=0)), "window": window}
    return pickle.dumps(data)


def write_blocks(benchmark: DataFrame, folder: str, window: int, block: int) -> tuple[int, int]:
    """Store the benchmark (item_id, text) in blocks of about `block` bytes; their number, and the words of the longest item."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of().cast("binary").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = int(total // block) + 1

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        put(f"{folder}/block-{int(pdf['part'].iloc[0]):06d}", data := block_of(pdf["item"].tolist(), pdf["text"].tolist(), window))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "longest": [pickle.loads(data)["longest"]]})

    made(benchmark.sparkSession, folder)
    dealt = rows.distinct().withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
    done = dealt.groupBy("part").applyInPandas(write, "part int, longest long").agg(F.sort_array(F.collect_list("part")).alias("p"), F.max("longest").alias("m")).first()
    with_rows = list(done["p"])
    put(f"{folder}/blocks", json.dumps(with_rows).encode())
    return len(with_rows), done["m"] or 0


@lru_cache(maxsize=1)
def _block(folder: str, part: int) -> dict:
    data = pickle.loads(get(f"{folder}/block-{part:06d}"))
    return data | {"words": data["vocabulary"].split(b" ") if data["vocabulary"] else []}


@lru_cache(maxsize=1)
def _blocks(folder: str) -> list[int]:
    return json.loads(get(f"{folder}/blocks"))


def _pieces(text: bytes, size: int, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text, about `size` bytes at a time and `overlap` words again, each with the number of its first word."""
    text, at, first, held = text.translate(WORDS), 0, 0, []
    while at <= len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        words = held + text[at:end].split()
        yield first, words
        held = words[max(len(words) - overlap, 0) :] if overlap else []
        first, at = first + len(words) - len(held), end + 1


class Shard:
    """Documents' words (doc: their number; first: the number of their first word), and what the benchmark hits in them."""

    def __init__(self, rows: list[tuple[int, int, list[bytes]]], depth: int):
        self.numbers = Numbers({b"": 0})
        sizes = np.array([len(w) + 1 for _, _, w in rows])
        self.begin = np.cumsum(sizes) - sizes
        self.doc, self.first = (np.array([r[k] for r in rows]) for k in (0, 1))
        ids = np.zeros(int(sizes.sum()), np.int64)
        for b, (_, _, words) in zip(self.begin.tolist(), rows, strict=True):
            ids[b : b + len(words)] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.depth, self.suffixes = depth, Suffixes(ids, len(self.numbers), depth)

    def hits(self, block: dict, found: list[dict]) -> None:
        """Note in `found`, by document, its spans, items and longest match."""
        known = np.array([0, *(self.numbers.get(w, 0) for w in block["words"])], np.int64)
        ids = known[block["ids"]]
        tests = Suffixes(ids, len(self.numbers), self.depth)
        maybe = np.flatnonzero(tests.left[block["first"]] >= block["length"])
        first, length = block["first"][maybe], block["length"][maybe]
        low, high = self.suffixes.found(tests.keys, first, length)
        places = self.suffixes.slots[_ranges(low, high - low)]
        if not len(places):
            return
        lengths, kinds = np.repeat(length, high - low), np.repeat(maybe, high - low)
        edges = np.bincount(places, minlength=self.suffixes.n + 1) - np.bincount(places + lengths, minlength=self.suffixes.n + 1)
        inside = np.diff(np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8)]))
        begins, ends = np.flatnonzero(inside > 0), np.flatnonzero(inside < 0)
        row = lambda at: np.searchsorted(self.begin, at, "right") - 1
        in_row = row(begins)
        for r, b, e in zip(in_row.tolist(), *((x - self.begin[in_row] + self.first[in_row]).tolist() for x in (begins, ends)), strict=True):
            found[self.doc[r]].setdefault("spans", []).append((b, e))
        names, items, upto = block["names"], block["items"], block["upto"]
        met = np.unique(row(places) * len(block["first"]) + kinds)
        for r, kind in zip(*(x.tolist() for x in np.divmod(met, len(block["first"]))), strict=True):
            found[self.doc[r]].setdefault("kinds", set()).add(kind)
        for doc in {self.doc[r] for r in set(in_row.tolist())}:
            own = found[doc].setdefault("items", set())
            for kind in found[doc].pop("kinds", ()):
                own.update(names[k] for k in items[upto[kind] : upto[kind + 1]].tolist())
        # The longest match of an item is at least a window of it: where it isn't, the longest hit of a short item.
        last = np.lexsort((kinds, lengths, places))
        last = last[np.append(places[last][1:] != places[last][:-1], True)]
        places, lengths, kinds = places[last], lengths[last], kinds[last]
        n, at = tests.longest(self.suffixes, places)
        whole = n < block["window"]
        n, at = np.where(whole, lengths, n), np.where(whole, block["first"][kinds], at)
        in_row = row(places)
        best = np.lexsort((places, -n, in_row))
        best = best[np.concatenate([[True], in_row[best][1:] != in_row[best][:-1]])]
        for r, k in zip(in_row[best].tolist(), best.tolist()):
            item = int(block["item"][at[k]])
            match = (int(n[k]), -int(places[k] - self.begin[r] + self.first[r]), names[item], int(at[k] - block["begin"][item]))
            found[self.doc[r]]["longest"] = max(found[self.doc[r]].get("longest", match[:1]), match)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _judged(texts: list[bytes], folder: str, longest: int, shard: int) -> tuple[np.ndarray, list[dict]]:
    """How many words each text has, and what the benchmark hits in it."""
    n_words, found = np.zeros(len(texts), np.int64), [{} for _ in texts]
    rows, held = [], 0

    def meet() -> None:
        if held:
            own = Shard(rows, longest)
            for part in _blocks(folder):
                own.hits(_block(folder, part), found)

    for k, text in enumerate(texts):
        for first, words in _pieces(text, 6 * shard, max(longest - 1, 0)):
            n_words[k] = first + len(words)
            rows.append((k, first, words))
            held += len(words)
            if held >= shard:
                meet()
                rows, held = [], 0
    meet()
    return n_words, found


def _results(n_words: np.ndarray, found: list[dict]) -> list[pa.Array]:
    spans = [_merged(x.get("spans", [])) for x in found]
    longest = [{"item": x["longest"][2], "item_word": x["longest"][3], "doc_word": -x["longest"][1], "n_words": x["longest"][0]} if "longest" in x else None for x in found]
    return [
        pa.array(n_words), pa.array([sum(e - b for b, e in x) for x in spans], pa.int64()), pa.array([sorted(x.get("items", ()), key=str.encode) for x in found], pa.list_(pa.string())),
        pa.array([[{"from_word": b, "to_word": e} for b, e in x] for x in spans], SPANS), pa.array(longest, LONGEST),
    ]


def leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = 10, shard: int = 500_000, block: int = 2_000_000) -> DataFrame:
    """The kept columns of docs, and of each text: its words, how many of them lie in a hit, the items hit, the spans of
    hit words, and the longest verbatim match with an item. shard: words sorted at a time; block: bytes of the benchmark."""
    folder = fresh_path(docs.sparkSession, "benchmark")
    _, longest = write_blocks(benchmark, folder, window, block)
    keep = [c for c in keep if c.lower() not in FIELDS]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _results(*_judged(batch.column(0).to_pylist(), folder, longest, shard))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], [*batch.schema.names[1:], *FIELDS])

    rows = docs.select(text_of().cast("binary").alias("_text"), *keep)
    return rows.mapInArrow(judge, StructType([*docs.select(*keep).schema, *StructType.fromDDL(RESULT)]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard: int = 500_000, block: int = 2_000_000) -> DataFrame:
    """docs without those in which any window of the benchmark stands."""
    folder = fresh_path(docs.sparkSession, "benchmark")
    _, longest = write_blocks(benchmark, folder, window, block)
    column = [c.lower() for c in docs.columns].index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()
            yield batch.filter(pa.array(["spans" not in x for x in _judged(texts, folder, longest, shard)[1]], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""WITH w AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
 t AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i+least(10, len(ws))-1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(ws)-9, 1)+1)) AS i FROM b WHERE len(ws) > 0)),
 o AS (SELECT d, i, k, array_to_string(ws[i:i+k-1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws)-k+2)) AS i FROM w, (SELECT DISTINCT k FROM t) WHERE len(ws) >= k)),
 h AS (SELECT d, i, o.k AS k, item_id FROM o JOIN t ON t.k = o.k AND t.win = o.win),
 n AS (SELECT d, count(DISTINCT p) AS n FROM (SELECT d, unnest(range(i, i+k)) AS p FROM (SELECT DISTINCT d, i, k FROM h)) GROUP BY d),
 m AS (SELECT d, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT d, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY d)
SELECT doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.s, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
 FROM w LEFT JOIN n ON n.d = w.d LEFT JOIN m ON m.d = w.d"""

QUERIES = {"op11_decontamination": op11_decontamination}
ORACLE_SQL = {"op11_decontamination": SQL}

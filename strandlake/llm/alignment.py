"""Two tokenizers' ids for one text, aligned by bytes.

A text's bytes get one label each: none, A-end, B-end or both, by whether a token of tokenizer A or B ends there. A pattern
reads spans up to each both-label off the label string: such a span is a group, and the labels in it count its tokens of
either side. Between two labels that follow each other lies the overlap of one A token and one B token: a link. How many
documents hold a pair of ids linked is counted over the corpus, from each document's distinct pairs.

Both tokenizers begin anew where white space follows a word, so a text is cut there, and what a segment (white space
and a word) becomes is worked out once and then looked up. A text with signs for which this may not hold is aligned as a whole.

Each text is encoded once. Its counts, its groups and its distinct pairs (with how often each is linked) are
stored; the corpus counts are summed from the stored pairs, by task first. They are looked up in memory where they are
at most `held` pairs, a fixed size; beyond that documents' pairs are joined with them, a pair that `dealt` documents hold being
dealt to another task for each so many of them.

Defined results: a null or empty text, and one that either side's tokens don't spell, has no tokens: zeros and an empty string;
repeated rows and ids are rows of their own, and each counts as a document; an empty table gives no rows; columns but doc_id and
text aren't read; a text of any length is aligned whole (its bytes, ids and labels are in memory at a time).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_of
from .tokens import Numbers, _ranges, in_turn

#: Texts of these signs are cut: B doesn't change them, and to A they are letters, digits, signs or white space beyond doubt.
PLAIN = re.compile(r"[\t\n -~À-ÖØ-öø-ž¡«»¿–—‘-”…€]*")
SEGMENTS = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
LABELS = bytes.maketrans(b"\x00\x01\x02\x03", b".abx")
SPAN = re.compile(rb"[^x]*x")
ROWS = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
_READY: dict = {}


def _spelled_by_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer: its signs stand for bytes, printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    out = [b""] * tokenizer.get_vocab_size()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    for token, k in tokenizer.get_vocab().items():
        out[k] = b"" if token in special else bytes(signs[c] for c in token)
    return out


def labels(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """0, 1, 2, 3 for each byte: no token ends there, one of A, one of B, one of both."""
    out = np.zeros(int(sizes_a.sum()), np.uint8)
    out[np.cumsum(sizes_a) - 1] = 1
    out[np.cumsum(sizes_b) - 1] += 2
    return out


def group_sizes(label_string: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B are in each span up to a both-label."""
    ends = np.cumsum(np.fromiter(map(len, SPAN.findall(label_string)), np.int64))
    data = np.frombuffer(label_string, np.uint8)
    counted = lambda sign: np.diff(np.concatenate([[0], np.cumsum(data == ord(sign))[ends - 1]])) + 1
    return counted("a"), counted("b")


def links(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of A and of B of all links: one for each labelled byte, whose tokens began before and end there or later."""
    marks = label[label > 0]
    ends_a, ends_b = marks & 1, marks >> 1
    return a[np.cumsum(ends_a) - ends_a], b[np.cumsum(ends_b) - ends_b]


class Writer:
    """Groups as `a1,a2|b1;a3|b2,b3`. Every id is there twice as text: before a comma, and as its side's last."""

    def __init__(self, n_a: int, n_b: int):
        of = lambda n, end: np.array([f"{k}{sign}" for sign in (",", end) for k in range(n)], object)
        self.a, self.b = of(n_a, "|"), of(n_b, ";")

    def __call__(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[str]:
        """The ids' texts in order. in_a, in_b: how many of the ids are in each group."""
        out = np.empty(len(a) + len(b), object)
        for ids, own, before, names in ((a, in_a, np.cumsum(in_b) - in_b, self.a), (b, in_b, np.cumsum(in_a), self.b)):
            last = np.zeros(len(ids), np.int64)
            last[np.cumsum(own) - 1] = len(names) // 2
            out[np.arange(len(ids)) + np.repeat(before, own)] = names[ids + last]
        return out.tolist()


class Aligned:
    """Texts and what they become: numbers of tokens, groups and links (rows of `n`), written groups, and the linked pairs
    of all texts (A's id in the upper 32 bits). fits: whether both sides' tokens spell a text; all is 0 or empty if not."""

    def __init__(self, n: np.ndarray, written: list[str], pairs: np.ndarray, fits: np.ndarray):
        self.n, self.written, self.pairs, self.fits = n, written, pairs, fits
        self.begin = np.cumsum(n[3]) - n[3]

    def with_more(self, more: Aligned) -> Aligned:
        return Aligned(np.concatenate([self.n, more.n], axis=1), self.written + more.written, np.concatenate([self.pairs, more.pairs]), np.concatenate([self.fits, more.fits]))


NOTHING = Aligned(np.zeros((4, 0), np.int64), [], np.zeros(0, np.int64), np.zeros(0, bool))


class Aligner:
    """Both tokenizers, and the segments that were met: at most `kept`, or of `chars` characters, before all are let go."""

    def __init__(self, path_a: str, path_b: str, kept: int = 300_000, chars: int = 6_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        from tokenizers import Tokenizer

        self.a, self.b, self.kept, self.most = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), kept, chars
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        # Segments are encoded apart if no piece of B reaches over the white space before a word.
        self.apart = not any(re.search("[^▁]▁|[\t\n]", p) for p in pieces)
        self.line = len(self.b.encode("\n"))  # the added space and the line break: what comes behind is as if in a text
        spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) or self.b.is_unknown(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.spelled = _spelled_by_bytes(self.a), spelled_b
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in self.spelled]
        self.write = Writer(*map(len, self.spelled))
        self._forget()

    def _forget(self) -> None:
        self.at, self.chars, self.known = Numbers(), 0, NOTHING

    def _ids(self, rows: list[str], whole: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of A and of B: all ids of the rows (texts with a space before them, or segments), and how many are each row's."""
        if whole:
            of_a, of_b = [x.ids for x in self.a.encode_batch(rows, add_special_tokens=False)], [self.b.encode(t[1:]) for t in rows]
            flat_a, n_a = np.fromiter(chain.from_iterable(of_a), np.int64), np.fromiter(map(len, of_a), np.int64, len(rows))
        else:
            found = self.a.encode(rows, is_pretokenized=True, add_special_tokens=False)
            flat_a, n_a = np.array(found.ids, np.int64), np.bincount(np.array(found.word_ids, np.int64), minlength=len(rows))
            of_b = [x[self.line :] for x in self.b.encode(["\n" + t for t in rows], num_threads=1)]
        return [(flat_a, n_a), (np.fromiter(chain.from_iterable(of_b), np.int64), np.fromiter(map(len, of_b), np.int64, len(rows)))]

    def _fitting(self, texts: list[bytes], sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether both sides' tokens spell each text."""
        wanted = np.fromiter(map(len, texts), np.int64, len(texts))
        fits = np.ones(len(texts), bool)
        for (ids, n), spelled, sizes in zip(sides, self.spelled, self.sizes, strict=True):
            tokens = list(map(spelled.__getitem__, ids.tolist()))
            if b"".join(tokens) == b"".join(texts) and (_sums(sizes[ids], n) == wanted).all():
                continue
            stops = np.cumsum(n).tolist()
            fits &= np.array([b"".join(tokens[b:e]) == t for b, e, t in zip([0, *stops], stops, texts)])
        return fits

    def align(self, rows: list[str], whole: bool) -> Aligned:
        """All rows are labelled together: each ends with a both-label."""
        sides = self._ids(rows, whole)
        fits = self._fitting([t.encode() for t in rows], sides)
        a, b = (ids[np.repeat(fits, n)] for ids, n in sides)
        counts = np.zeros((4, len(rows)), np.int64)
        if not len(a):
            return Aligned(counts, [""] * len(rows), np.zeros(0, np.int64), fits)
        n_a, n_b = (n[fits] for _, n in sides)
        sizes = [size[x] for size, x in zip(self.sizes, (a, b))]
        label = labels(*sizes)
        in_a, in_b = group_sizes(label.tobytes().translate(LABELS))
        link_a, link_b = links(label, a, b)
        chars = _sums(sizes[0], n_a)
        counts[:, fits] = n_a, n_b, _sums(label == 3, chars), _sums(label > 0, chars)
        tokens, stops = self.write(a, b, in_a, in_b), np.cumsum(counts[0] + counts[1]).tolist()
        return Aligned(counts, ["".join(tokens[b:e]) for b, e in zip([0, *stops], stops)], link_a << 32 | link_b, fits)

    def __call__(self, texts: list[str]) -> list[list]:
        """n_a, n_b, n_groups, n_links, groups, distinct pairs, how often each is linked: each a list over texts."""
        if len(self.at) > self.kept or self.chars > self.most:
            self._forget()
        cut = [SEGMENTS.findall(" " + t) if t and self.apart and PLAIN.fullmatch(t) else None for t in texts]
        odd = [k for k, c in enumerate(cut) if c is None and texts[k]]
        own = [c or () for c in cut]
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(own)), np.int64, sum(map(len, own)))
        if len(self.at) > len(self.known.written):
            new = list(islice(reversed(self.at), len(self.at) - len(self.known.written)))[::-1]
            self.chars += sum(map(len, new))
            self.known = self.known.with_more(self.align(new, False))
        rows, n_rows = self.known, np.fromiter(map(len, own), np.int64, len(own))
        if odd:
            rows = rows.with_more(self.align([" " + texts[k] for k in odd], True))
            parts = np.split(at, np.cumsum(n_rows)[:-1])
            for j, k in enumerate(odd):
                parts[k] = np.array([len(self.known.written) + j])
            at, n_rows = np.concatenate(parts), np.where(np.isin(np.arange(len(own)), odd), 1, n_rows)
        # A text that a segment doesn't fit has no tokens.
        fits = _sums(rows.fits[at], n_rows) == n_rows
        at, n_rows = at[np.repeat(fits, n_rows)], np.where(fits, n_rows, 0)
        counts = [_sums(x[at], n_rows).tolist() for x in rows.n]
        stops, places = np.cumsum(n_rows).tolist(), at.tolist()
        written = ["".join(map(rows.written.__getitem__, places[b:e]))[:-1] for b, e in zip([0, *stops], stops)]
        linked = rows.n[3][at]
        pairs, times, n_pairs = _distinct(np.repeat(np.arange(len(texts)), _sums(linked, n_rows)), rows.pairs[_ranges(rows.begin[at], linked)], len(texts))
        ends = np.cumsum(n_pairs).tolist()
        spans = [slice(b, e) for b, e in zip([0, *ends], ends)]
        return [*counts, written, [pairs[p].tobytes() for p in spans], [times[p].tobytes() for p in spans]]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of so many values each."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])


def _distinct(text: np.ndarray, pairs: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct pairs in order, how often each comes, and how many a text has."""
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    bits = int(b.max(initial=0)).bit_length()
    pair = a << bits | b
    wide = int(pair.max(initial=0)).bit_length()
    key, times = np.unique(text << wide | pair, return_counts=True)  # a chunk has far fewer texts than 2^30
    pair = key & ((1 << wide) - 1)
    return ((pair >> bits) << 32 | pair & ((1 << bits) - 1)).astype("<i8"), times.astype("<i4"), np.bincount(key >> wide, minlength=n_texts)


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's own."""
    if (path_a, path_b) not in _READY:
        _READY.clear()
        _READY[path_a, path_b] = Aligner(path_a, path_b)
    return _READY[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """ROWS of docs (doc_id, text). groups: `a1,a2|b1;a3|b2,b3`, the ids of each group, or with digest its sha256."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_texts = aligner(path_a, path_b)
        for batch in batches:
            doc_ids = batch.column(0)
            for first, texts in in_turn(batch.column(1).to_pylist(), 500_000):
                found = align_texts(texts)
                if digest:
                    found[4] = [sha256(x.encode()).hexdigest() if x else "" for x in found[4]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                columns = [pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, n), pa.array(np.zeros(n, np.int64)), *columns], [x.split()[0] for x in ROWS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(align, ROWS)
    return rows.withColumn("row", F.monotonically_increasing_id())


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of bytes, all in a row, and how many are each row's."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def pair_counts(rows: DataFrame, held: int = 2_000_000) -> DataFrame:
    """pair, n (documents that hold it linked), best: whether no pair of the same A id has more. rows: of aligned(), stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        put = lambda: pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
        for batch in batches:
            new, times = np.unique(_numbers(batch.column(0), "<i8")[0], return_counts=True)
            both, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            pairs, n = both, np.bincount(at, np.concatenate([n, times]), len(both)).astype(np.int64)
            if len(pairs) > held:
                yield put()
                pairs, n = pairs[:0], n[:0]
        yield put()

    counts = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # The pairs of one A id are no more than B has ids.
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def with_counts(rows: DataFrame, counts: DataFrame, held: int = 4_000_000, dealt: int = 1_000_000) -> DataFrame:
    """rows with n_best (links whose pair is best) and count_sum (of n over links). rows, counts: stored."""
    return _looked_up(rows, counts) if counts.count() <= held else _joined(rows, counts, dealt)


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """By a broadcast of all counts, 16 bytes a pair; negative ones are best."""
    found = counts.select("pair", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n")).toArrow()
    order = np.argsort(found.column("pair").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((found.column("pair").to_numpy()[order], found.column("n").to_numpy()[order]))
    names = [c for c in rows.columns if c not in ("pairs", "times")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value
        for batch in batches:
            (pairs, sizes), (times, _) = _numbers(batch.column(0), "<i8"), _numbers(batch.column(1), "<i4")
            own = n[np.searchsorted(known, pairs)] if len(pairs) else np.zeros(0, np.int64)
            ends = np.cumsum(sizes)
            sums = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sums(times * (own < 0))), pa.array(sums(times * np.abs(own)))], [*names, "n_best", "count_sum"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in names)
    return rows.select("pairs", "times", *names).mapInArrow(look_up, f"{schema}, n_best long, count_sum long")


def _joined(rows: DataFrame, counts: DataFrame, dealt: int) -> DataFrame:
    """By a join on pair and part: n is the number of rows that a pair has, so its parts have at most about `dealt` rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (pairs, sizes), (times, _) = _numbers(batch.column(1), "<i8"), _numbers(batch.column(2), "<i4")
            row = np.repeat(batch.column(0).to_numpy(), sizes)
            for k in range(0, len(row), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 500_000]) for x in (row, pairs, times.astype(np.int64))], ["row", "pair", "times"])

    parts = F.ceil(F.col("n") / dealt).cast("int")
    hot = counts.where(F.col("n") > dealt).select("pair", parts.alias("_parts"))
    single = rows.select("row", "pairs", "times").mapInArrow(cut, "row long, pair long, times long")
    # Pairs that so many documents hold are few; the join leaves it to Spark whether they are small enough to broadcast.
    single = single.join(hot, "pair", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("_parts", F.lit(1))).cast("int"))
    copies = counts.select("pair", "n", "best", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("part"))
    sums = single.join(copies, ["pair", "part"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    rows = stored(rows, "aligned")
    out = with_counts(rows, stored(pair_counts(rows), "pair-counts"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op12_alignment": op12_alignment}

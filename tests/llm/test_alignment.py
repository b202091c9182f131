"""Tokenizers aligned by bytes, against a plain version that compares all token ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strandlake.llm import alignment
from strandlake.llm.common import stored

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", " \n \n", "a", "a ", " a", "tab\tand  two   spaces\n\nlines \n", "<|endoftext|> is plain <s> text </s>", "<0x0A> ▁ piece", "naïve café — “quoted” …", "日本語のテキスト",
    "é ﬁ   x", "a\x00b\x01", "👍🏽 emoji", "don't DON'T I'll 12345 6.7%", "word " * 3000, "x" * 5000, "\r\nwin\r\n", "ſpecial ŉ İ", "same text", "same text",
]


def plain(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    found = []
    for text in texts:
        text = text or ""
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
        spelled_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            found.append(([], [], [], []))
            continue
        ranges = []
        for ids, spelled in ((ids_a, spelled_a), (ids_b, spelled_b)):
            at, out = 0, []
            for k, x in zip(ids, spelled, strict=True):
                out.append((k, at, at + len(x)))
                at += len(x)
            ranges.append(out)
        links, j = [], 0
        for k, begin, end in ranges[0]:
            while ranges[1][j][2] <= begin:
                j += 1
            m = j
            while m < len(ranges[1]) and ranges[1][m][1] < end:
                links.append((k, ranges[1][m][0]))
                m += 1
        both = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups, last = [], 0
        side = lambda rows, lo, hi: ",".join(str(k) for k, s, _ in rows if lo <= s < hi)
        if len(whole) < 20_000:
            for e in both:
                groups.append("|".join(side(rows, last, e) for rows in ranges))
                last = e
        found.append((ids_a, ids_b, groups or [None] * len(both), links))
    count = Counter(p for x in found for p in set(x[3]))
    best = defaultdict(int)
    for (k, _), n in count.items():
        best[k] = max(best[k], n)
    return [(len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), None if x[2][:1] == [None] else ";".join(x[2])) for x in found]


def rows_of(df, text="groups"):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r[text]) for r in df.collect()}


@pytest.mark.parametrize("held", [4_000_000, 0])
def test_odd_texts(spark, held):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, groups string")
    rows = stored(alignment.aligned(docs, A, B), "t")
    counts = stored(alignment.pair_counts(rows, 5), "t")
    found, expected = rows_of(alignment.with_counts(rows, counts, held, dealt=2)), plain(ODD)
    for k, own in enumerate(expected):
        assert found[k][:6] == own[:6] and own[6] in (None, found[k][6]), repr(ODD[k])[:60]
    assert sum(x[0] > 0 for x in expected) >= 14  # the odd texts do have tokens


def test_whole_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = rows_of(alignment.op12_alignment(spark, SF), "groups_sha256")
    assert len(found) == len(texts)
    for k, own in zip(texts, plain(texts.values()), strict=True):
        assert found[k][:6] == own[:6]
        assert own[6] is None or found[k][6] == (hashlib.sha256(own[6].encode()).hexdigest() if own[6] else "")


def test_defined_cases(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (5, "a b", 2), (5, "a b", 3), (6, None, 4)], "doc_id long, text string, row long")
    rows = stored(alignment.aligned(docs, A, B), "t")
    out = alignment.with_counts(rows, stored(alignment.pair_counts(rows), "t")).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [(r.doc_id, r.n_a, r.n_best, r.count_sum) for r in out] == [(None, 2, 2, 6), (5, 2, 2, 6), (5, 2, 2, 6), (6, 0, 0, 0)]
    none = stored(alignment.aligned(docs.limit(0), A, B), "t")
    for held in (10, -1):
        assert alignment.with_counts(none, stored(alignment.pair_counts(none), "t"), held).count() == 0


def test_groups_and_links_by_hand():
    label = alignment.labels(np.array([2, 1, 3]), np.array([3, 1, 2]))
    text = label.tobytes().translate(alignment.LABELS)
    assert text == b".axb.x"
    sizes = alignment.group_sizes(text)
    assert [x.tolist() for x in sizes] == [[2, 1], [1, 2]]
    assert alignment.Writer(10, 10)(np.array([1, 2, 3]), np.array([7, 8, 9]), *sizes) == ["1,", "2|", "7;", "3|", "8,", "9;"]
    assert [x.tolist() for x in alignment.links(label, np.array([1, 2, 3]), np.array([7, 8, 9]))] == [[1, 2, 3, 3], [7, 7, 8, 9]]


def test_segments_are_encoded_as_in_the_text():
    """All texts at once, then one by one with segments let go in between, and each as a whole."""
    tools = alignment.Aligner(A, B, kept=3)
    assert tools.apart
    rng = random.Random(1)
    made = ["".join(rng.choice(["a", "Word", "don't", "12", "é", ".", "…", " ", " ", "  ", "\n", "\n\n", "\t", "<|endoftext|>"]) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    texts = [x for x in ODD if x] + made
    at_once, whole = tools(texts), tools.align([" " + t for t in texts], True)
    assert [at_once[k] for k in range(4)] == whole.n.tolist() and at_once[4] == [w[:-1] for w in whole.written]
    for k, t in enumerate(texts[:60]):
        assert [x[0] for x in tools([t])] == [x[k] for x in at_once]

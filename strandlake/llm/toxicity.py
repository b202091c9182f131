"""Toxicity by multiple-instance learning: labels stand on documents, scores on sentences.

A sentence's score is a logistic function of its words and their beginnings. A document is toxic unless all of its
sentences are clean and no leak (a label without a reason in the text) happens: 1 - (1 - leak) * product of
(1 - sentence score). All weights are fitted together to document labels by the likelihood of that noisy-or, so the
sentences that explain a label are found on the way; `located` returns them.

The fit reads a sample of labelled documents of about `sample` rows, by hash. Its features are counted over the sample
by Spark; all that stand out in toxic documents are kept (no more than the sample has words), and the driver fits one
weight each from rows that hold only those. Scoring reads every whole text, a sentence at a time.

Defined results: a null text counts as empty; a text without a known feature has the leak as its score; tied and repeated
rows, and null ids, are scored like any other; a text of any length is read whole; further columns, of any name, aren't
read; an empty table gives an empty result; without labels all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, labels_of, stored, table, text_of

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Lengths of the beginnings of a word that are features, besides the word itself.
BEGINNINGS = (3, 4, 5, 6)


def features_of(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) > n] + [word + "$"]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    leak: float

    def sentence(self, words: list[str], memo: dict) -> float | None:
        """The logit of a sentence, None without evidence."""
        found: set[str] = set()
        for w in words:
            own = memo.get(w)
            if own is None:
                own = memo[w] = tuple(f for f in features_of(w) if f in self.weights)
            if own:
                found.update(own)
        return self.bias + math.fsum(self.weights[f] for f in sorted(found)) if found else None

    def score(self, text: str, memo: dict) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (from, to, score) of each sentence with evidence."""
        clean, parts = 1 - self.leak, []
        for m in SENTENCE.finditer(text):
            z = self.sentence(WORD.findall(m[0].lower()), memo)
            if z is not None:
                p = 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
                clean *= 1 - p
                parts.append((m.start(), m.end(), p))
        return 1 - clean, parts


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature, in how many toxic and other documents of the task it is."""
    toxic: Counter = Counter()
    other: Counter = Counter()

    def made() -> pa.RecordBatch:
        names = list(toxic.keys() | other.keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (toxic, other))], ["feature", "toxic", "other"])
        toxic.clear()
        other.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else other).update({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
            if len(other) > 400_000:
                yield made()
    yield made()


def _evidence(kept: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                rows = [sorted({kept[f] for w in set(WORD.findall(s.lower())) for f in features_of(w) if f in kept}) for s in SENTENCE.findall(text)]
                out.append([x for x in rows if x])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["label", "sentences"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, steps: int = 400) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic); held-out documents are left out. About `sample` labelled
    ids, and at most twice as many rows of them."""
    known = labels_of(labels, "toxic")
    share = min(1.0, sample / max(1, known.count()))
    some = known.where(~held_out()).where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < round(share * 1_000_000))
    rows = stored(docs.select("doc_id", text_of().alias("text")).join(some, "doc_id").select("text", F.col("label").cast("int").alias("label")), "toxicity-sample")
    if rows.count() > 2 * sample:  # repeated ids: the bound is on rows, whatever the ids
        copy = F.row_number().over(Window.partitionBy(F.xxhash64("text"), "label").orderBy("text"))  # equal rows are told apart
        rows = stored(rows.withColumn("_copy", copy).orderBy(F.xxhash64("text", "label", "_copy"), "text").limit(2 * sample).drop("_copy"), "toxicity-bounded")
    totals = dict(rows.groupBy("label").count().collect())
    n_toxic, n_other = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    if not n_toxic or not n_other:
        return Model({}, 0.0, 1.0 if n_toxic else 0.0)
    counted = rows.mapInArrow(_feature_counts, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lift = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("other") + 0.5) / (n_other + 1))
    best = counted.where("toxic >= 3").withColumn("lift", lift).where("lift >= 3").withColumn("weight", F.col("toxic") * F.log("lift"))
    kept = {r.feature: k for k, r in enumerate(best.orderBy(F.desc("weight"), "feature").collect())}
    if not kept:
        return Model({}, 0.0, n_toxic / (n_toxic + n_other))
    found = rows.mapInArrow(_evidence(kept), "label int, sentences array<array<int>>")
    return _fitted(found.collect(), list(kept), steps)


def _fitted(rows: list, names: list[str], steps: int, rate: float = 0.1, decay: float = 0.2) -> Model:
    """Adam on the likelihood of labels, with decay times half the squared weights as penalty."""
    y = np.array([r.label == 1 for r in rows], float)
    doc = np.array([k for k, r in enumerate(rows) for _ in r.sentences], np.int64)
    sentence = np.array([k for k, s in enumerate(s for r in rows for s in r.sentences) for _ in s], np.int64)
    feature = np.array([f for r in rows for s in r.sentences for f in s], np.int64)
    theta = np.concatenate([np.zeros(len(names)), [-3.0, -4.0]])  # weights, bias, logit of the leak
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-2] + np.bincount(sentence, theta[feature], len(doc))
        p, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        log_clean = np.bincount(doc, -np.logaddexp(0, z), len(y)) - np.logaddexp(0, theta[-1])
        toxic = np.maximum(-np.expm1(log_clean), 1e-12)
        pull = np.where(y > 0, -np.exp(log_clean) / toxic, 1.0)  # d loss / d(sum of softplus)
        dz = pull[doc] * p
        grad = np.concatenate([np.bincount(feature, dz[sentence], len(names)) + decay * theta[:-2], [dz.sum() + 0.1 * (theta[-2] + 3), (pull * leak).sum() + 0.1 * (theta[-1] + 4)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({n: float(w) for n, w in zip(names, theta[:-2], strict=True) if abs(w) > 1e-3}, float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


LOCATED = "doc_id long, score double, sentences array<struct<from_char:int,to_char:int,score:double>>"


def located(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, score, and the sentences (by characters of the text) that score `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        kind = pa.list_(pa.struct([("from_char", pa.int32()), ("to_char", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1).to_pylist():
                if len(memo) > 300_000:
                    memo.clear()
                score, parts = model.score(text, memo)
                scores.append(score)
                found.append([{"from_char": a, "to_char": b, "score": p} for a, b, p in parts if p >= least])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "sentences"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, LOCATED)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = located(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_toxic_sentences"))


QUERIES = {"op1_toxicity": op1_toxicity}

"""Language identification by multilingual mixture inference.

Each language has a model of letter trigrams, counted over labelled texts. A document is a mixture of
languages: each word comes from one of them, by its trigrams' likelihood. Expectation-maximisation over a text's words
estimates the proportions; the set of languages is selected by likelihood less a penalty for each further language (half
the logarithm of the number of words, as in the Bayesian information criterion). The prediction is the language with the
largest proportion of the selected set.

The sample is of about `sample` labelled rows, by hash; the pipeline's stage counts all of them. Counts are summed by Spark, and `buckets` of them for each
language reach the driver and every task: the languages are a closed set (a hundred take 26 MB). Prediction reads every
whole text, a piece of some 1,000,000 characters at a time, of which one number a word and language is kept.

Defined results: `und` for a null text or one without a letter; tied and repeated rows, and null ids, are judged like any
other; a word of over a million letters is cut in pieces; further columns pass through, whatever their names; an empty
table gives an empty result; without labelled texts everything is `und`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, lean, stored, table, text_of

UND = "und"
#: Words from which a text's evidence is judged by the plain limit.
FULL = 50
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each letter, and where each word (a run of letters) starts among them."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[a]
    a = np.where(is_letter, a, 0).astype(np.uint64)
    h = a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    at = np.flatnonzero(is_letter[1:-1])
    starts = np.flatnonzero(~is_letter[at]) if len(at) else at  # at is one less than a letter's place in a
    return (h[at] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % buckets, starts


#: Characters of a text whose trigrams are looked up at a time.
PIECE = 1_000_000


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces of about size characters, cut before white space where there is any."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace() and end < at + 2 * size:
            end += 1
        yield text[at:end]
        at = end


def texts_of(column: pa.Array) -> Iterator[str]:
    """A batch's texts, null as empty: one at a time, as all of them are several times the batch."""
    return (x.as_py() or "" for x in column)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # bucket by language


def counted_trigrams(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang) to how often each bucket is found in a language. A piece of a text is in memory at a time."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(buckets, np.int64)
            for piece in pieces_of(text):
                counts[lang] += np.bincount(trigrams(piece, buckets)[0], minlength=buckets)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, sample: int | None = 20_000, buckets: int = 1 << 16, smooth: float = 0.2) -> Model:
    """The trigram models of docs (doc_id, text, lang); held-out documents and null languages are left out. sample: of about
    how many labelled rows (None: all)."""
    some = docs.where(~held_out() & F.col("lang").isNotNull())
    if sample is not None:
        share = min(1.0, sample / max(1, docs.where("lang IS NOT NULL").count()))
        some = some.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < round(share * 1_000_000))

    counted = some.select(text_of().alias("text"), "lang").mapInArrow(lean(lambda batches: counted_trigrams(batches, buckets)), "lang string, bucket long, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.full((buckets, len(languages)), smooth)
    counts[counted["bucket"], np.searchsorted(languages, counted["lang"].to_numpy(object).astype(str))] += counted["n"] if len(counted) else 0
    return Model(languages, (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32))


def proportions(log_lik: list[np.ndarray], rounds: int = 30) -> tuple[np.ndarray, float]:
    """Mixture proportions of words by expectation-maximisation, and the log-likelihood. log_lik: pieces, word by language."""
    tops = [x.max(axis=1, keepdims=True) for x in log_lik]
    lik = [np.exp(x - t) for x, t in zip(log_lik, tops, strict=True)]
    n = sum(map(len, lik))
    pi = np.full(log_lik[0].shape[1], 1 / log_lik[0].shape[1])
    for _ in range(rounds):
        new = sum((x * pi / (x @ pi)[:, None]).sum(axis=0) for x in lik) / n
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(sum(np.log(x @ pi).sum() + t.sum() for x, t in zip(lik, tops, strict=True)))


def _inferred(model: Model, text: str, size: int = PIECE) -> tuple[str, float, list[tuple[str, float]], float, int]:
    """What infer gives, then the evidence (see there) and the number of words."""
    log_lik, n_trigrams = [], 0
    for piece in pieces_of(text, size) if model.languages else ():
        at, starts = trigrams(piece, len(model.log_p))
        if len(at):
            log_lik.append(np.add.reduceat(model.log_p[at], starts, axis=0, dtype=np.float64))
            n_trigrams += len(at)
    if not n_trigrams:
        return UND, 0.0, [], 0.0, 0
    n_words = sum(map(len, log_lik))
    single = sum(x.sum(axis=0) for x in log_lik)
    best = int(single.argmax())
    chosen, pi, fit = [best], np.ones(1), float(single[best])
    score = float(1 / np.exp(np.clip(single - single[best], -700, 0)).sum())
    penalty = 0.5 * np.log(n_words + 1)
    if len(model.languages) > 1 and n_words > 1:
        every, full = proportions(log_lik)
        order = np.argsort(-every, kind="stable")
        for n in range(2, len(order) + 1):
            if full - (n - 1) * penalty <= fit - (len(chosen) - 1) * penalty:
                break  # no set of so many can be better
            own, loglik = proportions([x[:, order[:n]] for x in log_lik])
            if loglik - (n - 1) * penalty > fit - (len(chosen) - 1) * penalty:
                chosen, pi, fit = list(order[:n]), own, loglik
    first = int(pi.argmax())
    if len(chosen) > 1:
        score = float(pi[first])
    mixture = [(model.languages[k], float(p)) for k, p in zip(chosen, pi, strict=True)]
    return model.languages[chosen[first]], score, mixture, fit / n_trigrams + float(np.log(len(model.log_p))), n_words


def infer(model: Model, text: str) -> tuple[str, float, list[tuple[str, float]]]:
    """Predicted language, score, and the selected languages with their proportions."""
    return _inferred(model, text)[:3]


INFERRED = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"
#: evidence: a text's log-likelihood by its mixture over that of evenly likely trigrams, for each of its trigrams.
PROVED = f"{INFERRED}, evidence double, n_found int"
_KIND = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def identified(docs: DataFrame, model: Model, proved: bool = False, keep: list[str] | None = None, place: int | None = None) -> DataFrame:
    """docs with lang_pred, score and languages, with proved also evidence and n_found, the number of words (of these names, only the new columns). keep: columns of docs to pass through (None: all).
    place: where the text is in the first of these, a struct; without it, it is the column text, and goes to the workers beside them."""
    columns = [t.split(" ", 1) for t in (PROVED if proved else INFERRED).split(", ")]
    rest = [c for c in (docs.columns if keep is None else keep) if c not in [name for name, _ in columns]]
    text = "_text"
    while text.lower() in {c.lower() for c in docs.columns}:
        text += "_"
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(len(rest)) if place is None else pc.struct_field(batch.column(0), [place])
            found = [_inferred(model, t) for t in texts_of(own)]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([[{"lang": a, "share": p} for a, p in x[2]] for x in found], _KIND)]
            if proved:
                more += [pa.array([x[3] for x in found], pa.float64()), pa.array([x[4] for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *more], [*rest, *[name for name, _ in columns]])

    schema = docs.select(*rest).limit(0).select("*", *[F.lit(None).cast(t).alias(name) for name, t in columns]).schema
    return docs.select(*rest, *([text_of().alias(text)] if place is None else [])).mapInArrow(lean(run), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    own = F.transform("languages", lambda x: F.concat_ws("=", x["lang"], F.round(x["share"], 3).cast("string")))
    slim = docs.select("doc_id", "text")
    out = identified(slim, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.array_join(own, " ").alias("mixture"))


def order_statistics(rows: DataFrame, column: str, shares: list[float], fine: float = 1e5) -> list[float]:
    """For each share, the least value of column with that share of all rows at or below it, exactly; none without rows. Two
    steps: counts of ranges of values, of which there is a row each, then the rows of the range that holds the place."""
    cut = rows.select(F.col(column).alias("x"), F.floor(F.col(column) * fine).alias("range"))
    upto = F.sum("n").over(Window.orderBy("range"))  # a row a range
    counts = stored(cut.groupBy("range").agg(F.count("*").alias("n")).select("range", "n", upto.alias("upto")), "order-statistics")
    total, out = counts.agg(F.max("upto")).first()[0] or 0, []
    for share in shares if total else ():
        place = max(1, math.ceil(share * total))
        at = counts.where(F.col("upto") >= place).orderBy("range").first()
        own = cut.where(F.col("range") == at["range"]).groupBy("x").agg(F.count("*").alias("n"))
        own = own.select("x", (F.sum("n").over(Window.orderBy("x")) + F.lit(at["upto"] - at["n"])).alias("upto"))
        out.append(own.where(F.col("upto") >= place).agg(F.min("x")).first()[0])
    return out


def evidence_limits(docs: DataFrame, model: Model, quantile: float = 0.001) -> tuple[float, float]:
    """Of the evidence of all learned texts of FULL words or more: the median, and twice as far below it as the quantile is."""
    known = docs.where(~held_out() & F.col("lang").isNotNull())
    rows = stored(identified(known.select("text"), model, proved=True, keep=[]).where(F.col("n_found") >= FULL).select("evidence"), "evidence")
    median, low = order_statistics(rows, "evidence", [0.5, quantile]) or (0.0, -np.inf)
    return median, 2 * low - median


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3, main: float = 0.5) -> DataFrame:
    """docs of a known language that has at least `least` of the score and `main` of the text, and whose evidence is no less
    than that of learned texts; shorter texts than FULL words vary more and have a wider limit. The models and the limits are of
    all learned texts of the whole table. A text that is null, empty or without a letter goes; else odd rows as the module defines."""
    whole = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(whole, None)
    median, low = evidence_limits(whole, model)
    place = [c.lower() for c in docs.columns].index("text")
    out = identified(docs.select(F.struct("*").alias("row")), model, proved=True, keep=["row"], place=place)
    limit = F.lit(median) - F.lit(median - low) * F.sqrt(F.greatest(F.lit(1.0), F.lit(FULL) / F.col("n_found")))
    share = F.array_max(F.transform("languages", lambda x: x["share"]))
    out = out.where((F.col("lang_pred") != UND) & (F.col("score") >= least) & (share >= main) & (F.col("evidence") >= limit))
    return out.select("row.*")


QUERIES = {"op3_language_id": op3_language_id}

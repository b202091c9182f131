"""Each operator on odd rows (null, empty, long, repeated, extra columns, empty tables), and against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import chat_format, embeddings, language_id, mixing, packing, quality_rules, queries, simhash, token_files, toxicity, url_templates
from strandlake.llm.common import held_out, stored
from strandlake.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def odd_docs(spark, extra=()):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "  \n ", "en", "a", 4), (4, "word " * 30_000, "en", "a", 150_000), (None, "some text here", "en", "b", 14), (6, "same words in here", "en", "b", 18), (7, "same words in here", "fr", "b", 18), (7, "same words in here", "fr", "b", 18), *extra]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_all_registered():
    assert [int(k[2:].split("_")[0]) for k in sorted(queries.queries(), key=lambda k: int(k[2:].split("_")[0]))] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, expected = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    rows = lambda df: Counter(map(str, df[sorted(expected.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(found) == rows(expected)


def test_toxicity(spark):
    rng = random.Random(1)
    calm = ["the river runs past the mill", "we walked home in the rain", "bread and soup for dinner", "a train left at noon"]
    rows, marks = [], []
    for k in range(600):
        toxic = k % 5 == 0
        parts = rng.sample(calm, 3) + (["you filthy worthless scum"] if toxic else [])
        rng.shuffle(parts)
        rows.append((k, ". ".join(parts), "en", "s", 0))
        marks.append((k, 1, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), labels(spark, marks))
    found = {r.doc_id: r for r in toxicity.located(spark.createDataFrame(rows, DOCS), model).collect()}
    assert all((found[k].score >= 0.5) == bool(t) for k, _, t in marks)
    text = dict((r[0], r[1]) for r in rows)
    for k in range(0, 600, 5):
        assert ["scum" in text[k][s.from_char : s.to_char] for s in found[k].sentences] == [True]
    odd = toxicity.located(odd_docs(spark), model).collect()
    assert len(odd) == 8 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.fit(odd_docs(spark), labels(spark)).weights == {}
    assert toxicity.located(odd_docs(spark).limit(0), model).count() == 0


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """One id on many rows, equal and different ones: the fit gets no more rows than the bound says."""
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(ids[0], f"you scum {k % 90}", "en", "s", 0) for k in range(900)] + [(k, "calm words", "en", "s", 0) for k in ids[1:60]], DOCS)
    seen = []
    monkeypatch.setattr(toxicity, "_fitted", lambda rows, *rest: seen.append(len(rows)))
    toxicity.fit(docs, labels(spark, [(k, 1, int(k == ids[0])) for k in ids[:60]]), sample=100)
    assert seen and max(seen) <= 200


def test_toxicity_scores_are_the_noisy_or(spark):
    """Scores of the query's own model against a plain noisy-or over sentences, labels held out by the crc32 of the id."""
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, marks)
    assert model == toxicity.fit(docs.where(~held_out()), marks.where(~held_out()))
    out = {r.doc_id: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    for r in rows:
        clean = 1 - model.leak
        for sentence in re.split(r"[.!?\n]", r.text or ""):
            own = {w[:n] for w in re.findall(r"\w+", sentence.lower()) for n in (3, 4, 5, 6) if len(w) > n} | {w + "$" for w in re.findall(r"\w+", sentence.lower())}
            if own & model.weights.keys():
                clean /= 1 + math.exp(max(-60.0, min(60.0, model.bias + sum(model.weights[f] for f in own & model.weights.keys()))))
        assert abs(out[r.doc_id].score - (1 - clean)) < 1e-9
        assert out[r.doc_id].predicted == int(out[r.doc_id].score >= 0.5)
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_templates(urls, good):
    """The template of each (host, key) by recursion over a host's keys."""
    keys = {}
    for k, url in enumerate(urls):
        host, *path = url.split("://")[1].split("/")
        key = tuple("*" if re.search("[0-9]", x) else x.replace("*", "\\*") for x in path if x)
        keys.setdefault(host, {}).setdefault(key, []).append(good.get(k))
    out = {}

    def grow(host, own, template, level):
        every = [g for marks in own.values() for g in marks if g is not None]
        if len(own) < 2 or not 0 < sum(every) < len(every):
            for key in own:
                out[host, key] = template + "/*" * (len(key) - level)
            return
        branches = {}
        for key in own:
            segment = key[level] if level < len(key) else ""
            mine = [g for k, marks in own.items() for g in marks if g is not None and (k[level] if level < len(k) else "") == segment]
            rest, pooled = len(every) - len(mine), (sum(every) + 1) / (len(every) + 2)
            differs = bool(mine and rest) and abs(sum(mine) / len(mine) - (sum(every) - sum(mine)) / rest) > 1.96 * math.sqrt(pooled * (1 - pooled) * (1 / len(mine) + 1 / rest))
            if not segment:
                out[host, key] = template
            else:
                branches.setdefault(segment if differs else "*", {})[key] = own[key]
        for name, part in branches.items():
            grow(host, part, f"{template}/{name}", level + 1)

    for host, own in keys.items():
        grow(host, own, "", 0)
    return out


def test_templates_are_the_plain_ones(spark):
    """Hosts with mixed, deep and starred branches."""
    rng = random.Random(21)
    urls, good = [], {}
    for k in range(1500):
        host = rng.choice(["a.org", "b.org", "c.org"])
        path = [rng.choice("xyz*") for _ in range(rng.randrange(1, 5))] + [f"item{rng.randrange(60)}"] * (rng.random() < 0.8)
        urls.append(f"http://{host}/" + "/".join(path))
        bad = path[0] == "x" and host == "a.org" or path[:2] == ["y", "z"] and host != "c.org" or path[0] == "*" and "y" in path[2:]
        if rng.random() < 0.7:
            good[k] = int(not bad) if rng.random() < 0.95 else int(bad)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"template": F.lit(1), "key": F.lit(2)})
    found = url_templates.judge(pages, spark.createDataFrame(list(good.items()), "page_id long, good int")).collect()
    plain = plain_templates(urls, good)
    of = lambda url: plain[url.split("://")[1].split("/")[0], tuple("*" if re.search("[0-9]", x) else x.replace("*", "\\*") for x in url.split("://")[1].split("/")[1:])]
    assert {r.page_id: r.template for r in found} == {k: of(u) for k, u in enumerate(urls)}
    assert {r.template for r in found if r.verdict == "block"} and any("\\*" in r.template for r in found)
    sums = {}
    for k, u in enumerate(urls):
        if k in good:
            own = sums.setdefault((u.split("/")[2], of(u)), [0, 0])
            own[0] += good[k]
            own[1] += 1
    share = (sum(good.values()) + 1) / (len(good) + 1)
    for r in found:
        host = [sum(v[i] for (h, _), v in sums.items() if h == r.host) for i in (0, 1)]
        base = (host[0] + 10 * share) / (host[1] + 10)
        n = sums.get((r.host, r.template), [0, 0])
        assert abs(r.purity - (n[0] + 10 * base) / (n[1] + 10)) < 1e-9 and r.verdict == ("block" if r.purity < 0.5 else "allow")


def test_mixtures_are_the_plain_ones(spark):
    """op3's prediction against expectation-maximisation by plain loops, text in pieces as whole, and labels held out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    other = language_id.fit(docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang"))))
    assert other.languages == model.languages
    rows = docs.collect()
    out = {r.doc_id: r for r in language_id.op3_language_id(spark, SF).collect()}
    assert len(out) == len(rows)
    log_p = model.log_p.astype(np.float64)

    def fitted(words, languages):
        pi = [1 / len(languages)] * len(languages)
        for _ in range(30):
            new = [0.0] * len(languages)
            for w in words:
                top = max(w[k] for k in languages)
                own = [p * math.exp(w[k] - top) for p, k in zip(pi, languages, strict=True)]
                for k, x in enumerate(own):
                    new[k] += x / sum(own) / len(words)
            moved, pi = max(abs(a - b) for a, b in zip(pi, new, strict=True)), new
            if moved < 1e-4:
                break
        logs = [(max(w[k] for k in languages), w) for w in words]
        return pi, sum(top + math.log(sum(p * math.exp(w[k] - top) for p, k in zip(pi, languages, strict=True))) for top, w in logs)

    for r in rows[:40]:
        found = out[r.doc_id]
        at, starts = language_id.trigrams(r.text or "", len(log_p))
        if not len(at):
            assert (found.lang_pred, found.score) == ("und", 0.0)
            continue
        words = [[float(log_p[at[a:b], k].sum()) for k in range(len(model.languages))] for a, b in zip(starts, [*starts[1:], len(at)], strict=True)]
        every = range(len(model.languages))
        sets = [(max(sum(w[k] for w in words) for k in every), [max(every, key=lambda k: sum(w[k] for w in words))], [1.0])]
        order = sorted(every, key=lambda k: (-fitted(words, list(every))[0][k], k))
        for n in range(2, len(model.languages) + 1):
            pi, fit = fitted(words, order[:n])
            sets.append((fit - (n - 1) * 0.5 * math.log(len(words) + 1), order[:n], pi))
        _, chosen, pi = max(sets, key=lambda x: x[0])
        assert found.lang_pred == model.languages[chosen[max(range(len(pi)), key=lambda k: pi[k])]]
        if len(pi) > 1:
            assert abs(found.score - max(pi)) < 1e-6
    long = max((r.text for r in rows if r.text), key=len)
    assert language_id._inferred(model, long, 500)[0] == language_id._inferred(model, long)[0]
    clash = language_id.identified(docs.withColumns({"_text": F.lit("x"), "languages": F.lit(1)}), model)
    assert clash.where("_text = 'x'").count() == len(rows)


def test_urls(spark):
    urls = [None, "no scheme", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.example.com/en/1?q", "http://x.net/es/2#a", "http://com/", "http://sub.org?/p", "ftp://h/p/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    out = {r.page_id: r for r in url_templates.judge(pages.withColumn("host", F.lit(1)), none).collect()}
    assert [(out[k].host, out[k].path, out[k].rule, out[k].verdict) for k in range(9)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("x.net", "/es/2", "net/es/", "block"), ("com", "/", "com/", "allow"), ("sub.org", "", None, "allow"), ("h", "/p/q", None, "allow"),
    ]
    many = [(k, f"http://shop.org/{('spam', 'blog')[k % 2]}/item{k}") for k in range(400)]
    good = spark.createDataFrame([(k, k % 2) for k, _ in many], "page_id long, good int")
    found = url_templates.judge(spark.createDataFrame(many, "page_id long, url string"), good).collect()
    assert all(r.verdict == ("allow" if r.page_id % 2 else "block") and r.template in ("/spam/*", "/blog/*") for r in found)
    assert url_templates.judge(pages.limit(0), none).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.identified(docs.withColumn("score", F.lit("x")), model).where("lang IS NOT NULL AND n_chars > 40").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    odd = language_id.identified(odd_docs(spark), model).collect()
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"} and len(odd) == 8
    assert language_id.infer(language_id.fit(odd_docs(spark).limit(0)), "abc")[0] == "und"
    assert language_id.language_stage(spark, docs, SF).columns == docs.columns


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(60), "en", rng.choice(["a", "b", "c", None]), 0) for k in range(400)] + [(900 + k, "x " * 400, "en", "hot", 0) for k in range(200)]
    docs = odd_docs(spark, rows).drop("lang")
    shared = mixing.mixed(docs.withColumns({"place": F.lit(1), "target": F.lit("x"), "start": F.lit(0)})).collect()
    assert len(shared) == len(rows) + 8
    taken, target, full = Counter(), {}, Counter()
    for r in shared:
        assert len(r.served) == 3 and all(0 <= x <= r["size"] for x in r.served)
        taken[r.source] += sum(r.served)
        full[r.source] += r["size"]
        target[r.source] = r.target
    assert sum(taken.values()) == sum(full.values())  # the budget, to the word
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.PACKET and target[s] <= 3 * full[s] for s in target)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert Counter(map(str, again)) == Counter(map(str, shared))
    mix = mixing.mixing_stage(spark, odd_docs(spark, rows), SF)
    assert mix.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(len(words(r.text)) for r in mix.collect()) == sum(taken.values())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_is_the_queue(spark):
    """Packets one by one: the served words are those of the first packets by finish time, and no others."""
    rng = random.Random(13)
    docs = spark.createDataFrame([(rng.choice([None, 1, k]), "w " * rng.choice([1, 50, 200]) + str(k), "en", rng.choice("ab"), 0) for k in range(300)], DOCS)
    shared = mixing.mixed(docs).collect()
    queue = []
    for k, r in enumerate(shared):
        for copy in range(3):
            for first in range(0, r["size"], mixing.PACKET):
                n = min(mixing.PACKET, r["size"] - first)
                queue.append(((copy * r.source_size + r.start + first + n) / r.target, r.source, copy, r.start, n, k))
    left, plain = sum(r["size"] for r in shared), Counter()
    for *_, n, k in sorted(queue):
        plain[k] += min(n, left)
        left -= min(n, left)
    assert [sum(r.served) for r in shared] == [plain[k] for k in range(len(shared))]
    for source in "ab":  # the line has no gap
        own = sorted((r.start, r["size"]) for r in shared if r.source == source)
        assert all(x[0] + x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


ODD_TEXTS = ["It's  a\ttest, isn't it?", "naïve ÉCOLE œuvre — “x”", "日本語 text", "<|endoftext|> a", "x́y İstanbul", "a1b22 $$%", " lead", "trail \n\n", " nb sp"]


def test_token_files(spark, tmp_path):
    more = [(100 + k, t, "en", "s", 0) for k, t in enumerate(ODD_TEXTS)] + [(None, f"hot {k}", "en", "s", 0) for k in range(400)]
    docs = odd_docs(spark, more).withColumns({"again": F.lit("x"), "shard": F.lit("y")})
    folder = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, in several shards
    try:
        places = token_files.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = places.select("doc_id", "again")
    assert keys.distinct().count() == len(more) + 8
    assert places.where("doc_id IS NULL").select("shard").distinct().count() > 1  # rows of one id spread
    token_files.write_index(places, folder, 3)
    found = token_files.ids_at(token_files.find(keys, folder, 3), folder, 2).collect()
    plain = tokenizer("word_bpe_49k.json")
    expected = Counter((r.doc_id, np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == expected
    hashes = token_files.mixed(np.arange(5000, dtype=np.uint64), 1)
    index = token_files.Index(token_files.index_bytes(hashes, *(np.arange(5000),) * 3))
    assert (index.find(hashes)[1] == np.arange(5000)).all()
    assert sorted(index.function.slots(hashes)) == list(range(5000))
    assert (index.find(token_files.mixed(np.arange(10_000, 20_000, dtype=np.uint64), 1))[0] == -1).all()


@pytest.mark.parametrize("name,keeps_space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder(name, keeps_space):
    """Random texts over ASCII, the listed letters and signs, and some others, as the tokenizers library encodes them whole,
    with a cache that overflows."""
    from strandlake.llm import tokens

    rng = random.Random(12)
    own = [chr(k) for k in range(128)] + [chr(k) for k in range(0xA1, 0x180)] + list(tokens.SIGNS) + ["日", "́", " ", "K", "<|", "'s", "'LL", "  ", "\n\n", "<|endoftext|>"]
    plain, encode = tokenizer(name), tokens.Encoder(public_tokenizers.path(name), keeps_space, cached=300, chars=3000)
    for k in range(300):
        letters = own if k % 2 else [c for c in own if not tokens.ODD.search(c)]
        texts = ["".join(rng.choice(rng.choice((letters, "abc 'st\n"))) for _ in range(rng.randrange(60))) for _ in range(5)]
        ids, sizes = encode(texts, 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


@pytest.mark.parametrize("query", ["op5", "op8"])
def test_token_queries(spark, query):
    """start, length and check sum of op5 and op8 by the tokenizers library on whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    plain = tokenizer("word_bpe_49k.json" if query == "op5" else "byte_bpe_50k.json")
    ids = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs}
    if query == "op5":
        before, expected = 0, []
        for r in docs:
            expected.append((r.doc_id, before, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes())))
            before += len(ids[r.doc_id])
        assert sorted(tuple(r)[:4] for r in token_files.op5_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected
        return
    rows = sorted(packing.op8_packing(spark, SF).collect(), key=lambda r: (r.doc_id, r.start))
    upto, at = Counter(), Counter()
    for r in rows:
        own = ids[r.doc_id]
        assert r.start == upto[r.doc_id] and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        upto[r.doc_id] += r.length
    assert upto == {k: len(x) for k, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048
    groups = {}
    for r in rows:
        groups[r.step_group] = groups.get(r.step_group, 0) + r.length
    by_part = {}
    for g, n in groups.items():
        by_part.setdefault(g >> 40, []).append((g, n))
    for own in by_part.values():  # all groups but a partition's last ones hold about as many tokens
        full = [n for _, n in sorted(own)[:-1]]
        assert not full or max(full) <= 8 * 2048 and min(full) >= 4 * 2048


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 2, 3, 4, 50, 200)] + ["x # y\nx # y\n\n  \nz <|>", *ODD_TEXTS]
    docs = odd_docs(spark, [(100 + k, t, "en", "s", 0) for k, t in enumerate(texts)])

    def plain(text):
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(windows)
        again = {j for k, x in enumerate(windows) if n[x] > 1 for j in range(k, k + 3)}
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)

    out = quality_rules.with_counts(docs.withColumn("n_lines", F.lit("clash"))).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality_rules.COUNTS)) for r in out) == Counter((r.doc_id, *plain(r.text)) for r in docs.collect())


def test_quality_rules(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for k in range(900):
        bad = k % 3 == 0
        rows.append((k, " ".join(("#" if bad and rng.random() < 0.4 else "w") + str(rng.randrange(9999)) for _ in range(80)), "en", "s", 0))
        marks.append((k, int(not bad), 0))
    counts = stored(quality_rules.with_counts(spark.createDataFrame(rows, DOCS)).drop("text"), "counts")
    rules = quality_rules.fit(counts, labels(spark, marks))
    assert rules and rules[0][0].feature == "f_symbols"
    out = quality_rules.judge(counts, rules).collect()
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in out]) > 0.98
    assert quality_rules.fit(counts, labels(spark)) == []
    assert quality_rules.quality_stage(spark, odd_docs(spark).limit(0), SF).count() == 0


def plain_rules(rows, cuts, min_covered=2, min_precision=0.9):
    """The decision list of rows (values by feature, bad, grow) by plain loops over rows."""
    holds = lambda rule, v: all(v[f] > c if above else v[f] <= c for f, above, c in rule)
    rules = []
    while True:
        left = [r for r in rows if not any(holds(rule, r[0]) for rule in rules)]
        rule = []
        while True:
            own = [r for r in left if r[2] and holds(rule, r[0])]
            best, most = None, 1e-9
            total = sum(r[1] for r in own)
            if not total or total == len(own):
                break
            for f in sorted(cuts):
                for c in cuts[f]:
                    for above in (False, True):
                        hit = [r[1] for r in own if (r[0][f] > c) == above]
                        if sum(hit) >= min_covered:
                            gain = sum(hit) * (math.log2(sum(hit) / len(hit)) - math.log2(total / len(own)))
                            if gain > most + 1e-9:
                                best, most = (f, above, c), gain
            if best is None:
                break
            rule.append(best)
        counts = []
        for k in range(1, len(rule) + 1):
            own = [(r[2], r[1]) for r in left if holds(rule[:k], r[0])]
            counts.append((own.count((True, True)), own.count((True, False)), own.count((False, True)), own.count((False, False))))
        if not rule:
            return rules
        score = [round((p - n) / max(1, p + n), 3) for _, _, p, n in counts]
        k = max(range(len(rule)), key=lambda k: (score[k], counts[k][2], -k))
        bad, good, p, n = counts[k]
        if not (p and p >= min_precision * (p + n) and (bad + p + 1) / (bad + p + good + n + 2) >= min_precision):
            return rules
        rules.append(rule[: k + 1])


@pytest.mark.parametrize("seed,size", [(1, 60), (2, 400), (3, 1500)])
def test_rules_are_the_plain_ones(spark, seed, size):
    """Several rules of several conditions, and few labels."""
    rng = random.Random(seed)
    names = list(quality_rules.RATIOS)
    rows = []
    for _ in range(size):
        v = {c: float(rng.randrange(12)) for c in names}
        bad = (v[names[0]] > 8 and v[names[1]] <= 3) or v[names[2]] > 9 or (v[names[3]] <= 1 and v[names[4]] > 6 and v[names[5]] > 4)
        rows.append((v, bad, rng.randrange(3) > 0))
    frame = spark.createDataFrame([(*[v[c] for c in names], int(not bad), grow) for v, bad, grow in rows], ", ".join(f"{c} double" for c in names) + ", label int, grow boolean")
    found = quality_rules.learn(frame)
    cuts = {c: sorted({sorted(v[c] for v, *_ in rows)[max(0, math.ceil((k + 0.5) / 32 * size) - 1)] for k in range(32)}) for c in names}
    assert [[(c.feature, c.above, c.cut) for c in rule] for rule in found] == plain_rules(rows, cuts)
    assert len(found) >= (size > 100) + 2 * (size > 1000)


def plain_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = words(w)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(20)]
    near = [b[:-1] + "z" for b in base for _ in range(2)]
    docs = odd_docs(spark, [(100 + k, t, "en", "s", 0) for k, t in enumerate([*base, *near, *ODD_TEXTS])])
    rows = docs.collect()
    out = simhash.grouped(docs).collect()
    fps = {(r.doc_id, plain_fingerprint(r.text)) for r in rows}
    assert {(r.k_id, r.fp % 2**64) for r in out} == fps and len(out) == len(rows)
    for seed, size in ((1, 300), (2, 900)):  # both ways of comparing a group
        g = np.random.default_rng(seed)
        own = np.unique(np.array([x ^ (1 << int(g.integers(64))) for x in g.integers(0, 2**62, size // 3).tolist() for _ in range(3)] + [1 << k for k in range(40)] + [0], np.uint64))
        edges = simhash.links(spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp long"))
        roots = {r.node: r.root for r in components(edges).collect()}
        label = np.arange(len(own))
        near = np.bitwise_count(own[:, None] ^ own[None, :]) <= 2
        for _ in range(len(own)):
            new = np.where(near, label[None, :], len(own)).min(axis=1)
            if (new == label).all():
                break
            label = new
        signed = own.view(np.int64)
        mine = Counter(tuple(sorted(x)) for x in _groups({int(s): roots.get(int(s), int(s)) for s in signed}))
        assert mine == Counter(tuple(sorted(x)) for x in _groups({int(s): int(c) for s, c in zip(signed, label, strict=True)}))
    kept = simhash.simhash_stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == len({r.root for r in out})


def test_op7_components(spark):
    """component_id of whole documents by all pairs of plain fingerprints."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    least = {k: r.doc_id for k, r in enumerate(rows)}
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    while True:
        before = dict(least)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, SF).collect()}
    assert out == {r.doc_id: (f"{fps[k]:016x}", least[k]) for k, r in enumerate(rows)}


def test_key_of_too_many_members(spark):
    """Members of a key over the limit leave the task and are linked by two wildcards."""
    g = np.random.default_rng(5)
    low = g.integers(0, 2**32, 120, np.uint64)
    own = np.unique(np.concatenate([low, low ^ np.uint64(1), low ^ np.uint64(6), low ^ np.uint64(3 << 40)]))
    fps = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp long")
    one, two = ({r.node: r.root for r in components(simhash.links(fps, most)).collect()} for most in (10_000, 50))
    assert one == two and len(one) >= 240


@pytest.mark.parametrize("stage", [simhash.near_copies_stage, simhash.simhash_stage])
def test_stage_keeps_rows(spark, stage):
    """Repeated and null ids: a row goes only if one that resembles it stays."""
    rng = random.Random(11)
    text = {c: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for c in "abcxypk"}
    rows = [(3, "b"), (7, "a"), (7, "b"), (9, "a"), (9, "c"), (None, "x"), (None, "y"), (30, "p"), (30, "k"), (30, "k"), (30, "k")]
    docs = spark.createDataFrame([(i, text[c], "en", "s", 0) for i, c in rows], DOCS).withColumns({c: F.lit(c) for c in ("n", "k_id", "root", "row", "stays", "id")})
    kept = stage(spark, docs, SF)
    assert kept.columns == docs.columns
    back = {v: k for k, v in text.items()}
    assert Counter((r.doc_id, back[r.text]) for r in kept.collect()) == Counter([(3, "b"), (7, "a"), (9, "c"), (None, "x"), (None, "y"), (30, "p"), (30, "k")])
    assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("tile", [1 << 16, 40])
def test_near_links_of_large_groups(spark, tile):
    """Near fingerprints are joined, whether a key's rows are in one task or dealt to tiles."""
    g = np.random.default_rng(9)
    form = simhash.layout(1000)
    fps = g.integers(-(2**62), 2**62, (3, form.words))
    rows = []
    for k in range(300):
        flip = [int(np.bitwise_xor.reduce([0, *(1 << int(b) for b in g.integers(0, 62, 4))])) for _ in range(form.words)]
        rows.append((k, *[int(x) ^ f for x, f in zip(fps[k % 3], flip, strict=True)]))
    nodes = spark.createDataFrame(rows, "id long, " + ", ".join(f"fp{k} long" for k in range(form.words)))
    roots = {r.node: r.root for r in components(simhash.near_links(nodes, form, tile)).collect()}
    assert {k: roots.get(k, k) for k in range(300)} == {k: k % 3 for k in range(300)}


@pytest.mark.parametrize(("rows", "pivots"), [(1000, 16), (7, 16), (7, 1)])
def test_similar_sets(spark, rows, pivots, monkeypatch):
    """Links of exact similarity in clusters, in one tile or many, against all pairs. A chain's sets are similar to those
    near them only, so most are out of reach of its pivots."""
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    g = np.random.default_rng(10)
    sets = {}
    for k in range(90):
        base = np.arange(40, dtype=np.uint64) + np.uint64(1000 * (k % 3))
        sets[k] = np.unique(np.concatenate([base[g.random(40) > 0.1], g.integers(10_000, 20_000, g.integers(0, 4)).astype(np.uint64)]))
    sets[90] = sets[91] = np.zeros(0, np.uint64)
    for k in range(92, 132):
        sets[k] = np.arange(2 * k, 2 * k + 40, dtype=np.uint64) + np.uint64(100_000 + 1000 * (k > 120))
    cluster = {k: k % 3 // 2 if k < 92 else 2 for k in sets}
    frame = spark.createDataFrame([(cluster[k], k, bytearray(x.tobytes())) for k, x in sets.items()], "cluster long, id long, shingles binary")
    roots = {r.node: r.root for r in components(simhash.similar(frame, 0.8, rows)).collect()}
    label = {k: k for k in sets}
    near = [(a, b) for a in sets for b in range(a) if cluster[a] == cluster[b] and len(sets[a]) and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: roots.get(k, k) for k in sets} == label and len(set(label.values())) < 80


def _groups(root):
    by = {}
    for k, v in root.items():
        by.setdefault(v, []).append(k)
    return by.values()


def test_large_key_group():
    """A group over the limit of direct comparison gives the same components."""
    g = np.random.default_rng(3)
    low = g.integers(0, 2**32, 400, np.uint64)
    fps = np.unique(np.concatenate([low, low ^ np.uint64(1), low ^ np.uint64(6)]))
    small, simhash.SMALL = simhash.SMALL, 10_000
    one = simhash.linked(fps, 65)
    simhash.SMALL = 4
    two = simhash.linked(fps, 65)
    simhash.SMALL = small
    assert (one == two).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (5, 5), (300, 100)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(1, 61)) and out[200] == out[300] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark):
    docs = odd_docs(spark, [(100 + k, t * (1 + 200 * (k % 3)), "en", "s", 0) for k, t in enumerate(ODD_TEXTS)])
    rows = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    plain = tokenizer("byte_bpe_50k.json")
    expected = Counter((r.doc_id, np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect())
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    joined = Counter(b for parts in documents.values() for b in [b"".join(x for _, x in sorted(parts))])
    assert sum(map(len, joined.elements())) == sum(len(b) for _, b in expected.elements())
    single = {d: b for (d, b), n in expected.items() if d not in (None, 7)}
    assert all(b"".join(x for _, x in sorted(documents[d, len(b) // 4])) == b for d, b in single.items())
    padded = sum(2048 - n for own in sequences.values() for n in [sum(x for _, x in own)] if n & (n - 1))
    assert padded < 2048 * docs.rdd.getNumPartitions()


def test_chat(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "\\<|", "a\nb", "", None, "<|<\\|<\\\\|", "日本" * 1000]
    rows = [(c, t, ("user", "assistant", None, "a\nb<|")[(c + t) % 4], odd[(c * 3 + t) % 8]) for c in range(12) for t in range(9)] + [(None, None, "user", "x"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    steps = chat_format.steps(turns)
    out = {r.conv_id: r for r in chat_format.digest(steps).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert out[conv].n_turns == len(own) and out[conv].loss_chars == len(loss)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert out[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    examples = chat_format.expanded(steps.where("conv_id = 1")).orderBy("example").collect()
    assert len(examples) == sum(1 for r in rows if r[0] == 1 and r[2] == "assistant")
    assert all(b.context.startswith(a.context) and b.context.startswith(a.context + a.target) for a, b in zip(examples, examples[1:], strict=False))
    assert chat_format.digest(chat_format.steps(turns.limit(0))).count() == 0


def test_embeddings(spark):
    g = np.random.default_rng(8)
    base = g.standard_normal((40, 32))
    vectors = np.concatenate([base] + [base + g.standard_normal((40, 32)) * s for s in (0.05, 0.1, 0.2, 0.3)] + [base[:5]])
    rows = [(k, f"l{k % 2}", v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000, "l0", None), (1001, "l0", [0.0] * 32), (1002, "l0", [float("nan")] * 32), (1003, None, rows[0][2]), (1004, "l0", []), (1005, "l1", [None, 1.0])]
    out = {r.vec_id: r for r in embeddings.linked(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumn("n", F.lit(1))).collect()}
    assert len(out) == len(rows) and all(out[k].n_links == 0 and out[k].kept for k in range(1000, 1006))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    label = np.arange(len(vectors)) % 2
    true = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(vectors), dtype=bool)
    found = np.array([out[k].n_links for k in range(len(vectors))])
    assert (found <= true.sum(axis=1)).all() and found.sum() >= 0.95 * true.sum() > 0
    points = g.standard_normal((200, 8)) * 3
    near = embeddings.nearest_e8(points)
    far = ((points - near) ** 2).sum(axis=1)
    assert all((((points - near - n) ** 2).sum(axis=1) >= far - 1e-9).all() for n in embeddings.NEIGHBOURS)


@pytest.mark.parametrize("n,tile,setting", [(300, 2048, 0), (1500, 100, 0), (1500, 2048, 1), (1500, 2048, 2), (1500, 2048, 3)])
def test_recall(spark, n, tile, setting):
    """Pairs at and above the threshold, for several sizes, tiles and all settings: recall of 0.9 at least, and no false link."""
    g = np.random.default_rng(n + setting)
    base = g.standard_normal((n // 3, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = g.standard_normal((2, n // 3, 64))
    other -= (other * base).sum(axis=2, keepdims=True) * base
    other /= np.linalg.norm(other, axis=2, keepdims=True)
    cosine = g.uniform(0.931, 0.96, (2, n // 3, 1))
    hot = base[0] + g.standard_normal((200, 64)) * 0.02  # a cell of many
    vectors = np.concatenate([base, *(cosine * base + np.sqrt(1 - cosine**2) * other), hot])
    frame = spark.createDataFrame([(k, "l", v.tolist()) for k, v in enumerate(vectors)], "vec_id long, label string, embedding array<double>")
    options = dict(zip(("tables", "blocks", "probes", "scale"), embeddings.SETTINGS[setting][1:], strict=True))
    found = {r.vec_id: r.n_links for r in embeddings.linked(frame, tile=tile, **options).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    own = np.array([found[k] for k in range(len(vectors))])
    assert (own <= true).all() and own.sum() >= 0.9 * true.sum()
    assert own[: n // 3 * 3].sum() >= 0.9 * true[: n // 3 * 3].sum() > 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    """Nulls, an empty and a long text, repeated rows, an empty table, and columns with the names that stages use inside."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    clash = {c: F.lit(c) for c in ("n", "_text", "target", "source_size", "row", "line", "key", "size", "words", "finish", "k_id", "stays", "rule", "kept", "n_words", "score", "evidence", "languages")}
    docs = odd_docs(spark).withColumns(clash)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns and all(r.n == "n" and r._text == "_text" and r.key == "key" and r.score == "score" for r in rows)
    if name == "simhash near-duplicates":
        assert Counter(r.doc_id for r in rows) == Counter([1, 4, None, 6])
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_chat_rows_of_a_long_context(spark):
    """Turns beyond the length of a row go on in the next row of the same example."""
    rows = [(1, 0, "user", "x" * 50), (1, 1, "user", "y" * 50), (1, 2, "assistant", "first"), (1, 3, "user", "z"), (1, 4, "assistant", "second")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cut, whole = (chat_format.steps(turns, n) for n in (60, 10_000))
    ends = [[(r.example, r.n_turns) for r in x.orderBy("part").collect() if r.loss_from is not None] for x in (cut, whole)]
    assert ends[0] == ends[1] == [(0, 3), (1, 2)] and cut.count() > whole.count()
    assert [x.collect() for x in map(chat_format.read_back, map(chat_format.written, (cut, whole)))][0] == chat_format.digest(whole).collect()
    assert chat_format.expanded(cut).orderBy("example").collect() == chat_format.expanded(whole).orderBy("example").collect()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg(F.sum("length")).first()[0] > 0

"""Whole jobs on planted rows that a lesser version misses."""

import random

import corpus_pipeline

from strandlake.llm import chat_format, language_id, url_templates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def five(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies_of_the_stage(spark):
    """Copies with some words changed: with no lesser id of similarity 0.8 a text stays, else it goes."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts, base_of = [], []
    for base in range(60):
        own = [word() for _ in range(220)]
        texts.append(" ".join(own))
        base_of.append(base)
        for edits in (1, 2, 3, 3, 9, 15):
            copy = list(own)
            for k in rng.sample(range(5, 215), edits):
                copy[k] = word()
            texts.append(" ".join(copy))
            base_of.append(base)
    sets = [five(t) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if base_of[a] == base_of[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    true = {k for k in range(len(texts)) if top(k) == k}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash near-duplicates"](spark, docs, SF).select("doc_id").collect()}
    assert true <= kept  # nothing goes without proof
    assert len(kept - true) <= 0.01 * (len(texts) - len(true))


def test_written_examples(spark, monkeypatch):
    """What op9 stores holds each reply's whole context, and the digest is read from that."""
    rows = [(c, t, "assistant" if (c + t) % 3 == 0 else "user", f"c{c} t{t} <|x|>") for c in range(6) for t in range(8)] + [(9, 0, "user", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat_format, "table", lambda *_: turns)
    kept = {}
    monkeypatch.setattr(chat_format, "stored", lambda df, name: kept.setdefault(name, df.checkpoint()))
    out = {r.conv_id: r for r in chat_format.op9_prefix_targets(spark, SF).collect()}
    pieces = sorted(kept["chat-examples"].where("conv_id >= 0").collect(), key=lambda r: (r.conv_id, r.example, r.part))
    found = set()
    for conv, example in {(r.conv_id, r.example) for r in pieces}:
        own = [r for r in pieces if (r.conv_id, r.example) == (conv, example)]
        if own[-1].loss_from is not None:
            assert all(r.loss_from is None for r in own[:-1])
            text = "".join(r.text for r in own)
            end = len(text) - len(own[-1].text)
            found.add((conv, text[: end + own[-1].loss_from], text[end + own[-1].loss_from : end + own[-1].loss_to]))
    shown = lambda r: f"<|im_start|>{r[2]}\n{r[3]}<|im_end|>\n".replace("<|x|>", "<\\|x|>")
    said = lambda r: r[3].replace("<|x|>", "<\\|x|>")
    true = {(r[0], "".join(shown(x) for x in rows if x[0] == r[0] and x[1] < r[1]) + "<|im_start|>assistant\n", said(r)) for r in rows if r[2] == "assistant"}
    assert found == true
    assert out == {r.conv_id: r for r in chat_format.digest(kept["chat-steps"]).collect()}


def test_language_stage_rejects(spark):
    """Gibberish, a language never learned, half garbled and evenly mixed texts go; clean ones stay."""
    rng = random.Random(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("lang IS NOT NULL AND n_chars > 400").collect()
    own = {k: next(r.text for r in clean if r.lang == k and r.n_chars > 1500).split() for k in ("de", "en", "es")}
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    planted = [" ".join(noise), finnish * 3, " ".join(own["de"][:60] + noise[:60]), " ".join(own["de"][:80] + own["en"][:60] + own["es"][:60])]
    more = spark.createDataFrame([(-1 - k, t, "en", "s", len(t)) for k, t in enumerate(planted)], docs.schema)
    kept = {r.doc_id for r in language_id.language_stage(spark, docs.unionByName(more), SF).select("doc_id").collect()}
    assert not {-1, -2, -3, -4} & kept
    assert len({r.doc_id for r in clean} - kept) <= 0.01 * len(clean)


def test_rare_and_deep_sections(spark):
    """A bad section under 1% of a host with many sections, and one that differs in the sixth segment only, are blocked."""
    urls = [(f"http://hot.org/s{chr(97 + k % 20)}/item{k}", 1) for k in range(6000)]
    urls += [(f"http://hot.org/casino/item{k}", 0) for k in range(50)]
    urls += [(f"http://deep.org/a/b/c/d/e/{('fine', 'fine', 'fine', 'spam')[k % 4]}/item{k}", int(k % 4 < 3)) for k in range(200)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string")
    good = spark.createDataFrame([(k, g) for k, (_, g) in enumerate(urls)], "page_id long, good int")
    out = url_templates.judge(pages, good).collect()
    assert len(out) == len(urls)
    assert all(r.verdict == ("allow" if urls[r.page_id][1] else "block") for r in out)
    assert {r.template for r in out if r.verdict == "block"} == {"/casino/*", "/*/*/*/*/*/spam/*"}

"""What the language stage holds of a batch and of a long text."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.llm import language_id

SF = "/root/testdata/sf0.001"


def test_a_piece_of_a_text_at_a_time():
    text = "les mots d'un texte très long " * 300_000
    batch = pa.RecordBatch.from_pydict({"text": [text, None, "Σας ΣΟΦΟΣ\n"], "lang": ["fr", "fr", "el"]})
    tracemalloc.start()
    found = list(language_id.counted_trigrams(iter([batch]), 1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = language_id.trigrams(text, 1 << 16)[0]
    assert [b.column("n").to_pylist() for b in found][0] == [x for x in language_id.np.bincount(own) if x]
    assert sum(found[1].column("n").to_pylist()) == 8
    assert peak < 150_000_000  # the whole text's arrays take several times as much


def test_texts_go_to_workers_once(spark):
    """The stage's rows have their text in them; no second copy is sent beside it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("note", F.lit(1))
    out = language_id.language_stage(spark, docs, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sent = [x for x in plan.splitlines() if "Project" in x]
    assert sent and not any("coalesce(text" in x for x in sent)
    plain = language_id.identified(docs.select(F.struct("*").alias("row"), "text"), model := language_id.fit(docs, None), proved=True, keep=["row"])
    placed = language_id.identified(docs.select(F.struct("*").alias("row")), model, proved=True, keep=["row"], place=1)
    assert sorted(map(str, plain.collect())) == sorted(map(str, placed.collect()))

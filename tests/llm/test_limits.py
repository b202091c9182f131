"""The language stage's model and limits are of all learned texts."""

import math
import random

from strandlake.llm import language_id

SF = "/root/testdata/sf0.001"


def test_order_statistics(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(2000)] + [0.25] * 300
    frame = spark.createDataFrame([(x,) for x in values], "x double").repartition(5)
    shares = [0.001, 0.25, 0.5, 1.0]
    expected = [sorted(values)[max(1, math.ceil(s * len(values))) - 1] for s in shares]
    assert language_id.order_statistics(frame, "x", shares) == language_id.order_statistics(frame, "x", shares, fine=0.5) == expected
    assert language_id.order_statistics(frame.limit(0), "x", shares) == []


def test_limits_of_all_texts(spark, monkeypatch):
    """No learned text is left out of the model or the limits."""
    docs = language_id.table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, None)
    rows = language_id.identified(docs.where(~language_id.held_out()).where("lang IS NOT NULL"), model, proved=True).where(f"n_found >= {language_id.FULL}")
    own = sorted(r.evidence for r in rows.select("evidence").collect())
    median, low = (own[max(1, math.ceil(s * len(own))) - 1] for s in (0.5, 0.001))
    assert language_id.evidence_limits(docs, model) == (median, 2 * low - median)
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda docs, *sample: seen.append(sample) or model)
    language_id.language_stage(spark, docs, SF)
    assert seen == [(None,)]

"""Few edges are joined by one task, and whole rows are joined alike at every size."""

import random

from strandlake.llm import components, simhash


def test_few_edges_in_one_task(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(250)], "a long, b long")
    found = [sorted(map(tuple, components.components(edges, few).collect())) for few in (0, 40, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_rows_meet_by_sorting(spark):
    """Texts aren't joined in one way while their partner is small and in another when it has grown."""
    docs = spark.createDataFrame([(k, f"some words of text number {k % 3} here", k) for k in range(9)], "doc_id long, text string, n long")
    found = simhash.with_sets(docs, 5, 0).select("k_id", "k_text", "id").withColumnRenamed("id", "root")
    out = simhash.one_of_each(docs, found)
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 3

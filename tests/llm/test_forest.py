"""Forests of edges join what all edges join; workers let go of what they kept."""

import numpy as np
import pyarrow as pa

from strandlake.llm import common, simhash


def parts(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {x: top(x) for x in root}


def test_forest_joins_the_same():
    rng = np.random.default_rng(7)
    for n, m in ((1, 0), (5, 3), (300, 200), (2000, 9000)):
        found = [(rng.integers(-n, n, m), rng.integers(-n, n, m)) for _ in range(3)]
        a, b = simhash._forest(found)
        full = parts([(int(x), int(y)) for p, q in found for x, y in zip(p, q, strict=True)])
        assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {x: y for x, y in full.items() if x != y}
    assert [len(x) for x in simhash._forest([])] == [0, 0]


def test_near_links_in_small_forests(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    ids = [(int(k), int(base[k % 40]) ^ (1 << int(k % 5))) for k in range(400)]
    form = simhash.Layout(12, 20, 4, 60)
    nodes = spark.createDataFrame([(i, f, f, f, f) for i, f in ids], "id long, fp0 long, fp1 long, fp2 long, fp3 long")
    whole = parts([tuple(r) for r in simhash.near_links(nodes, form).collect()])
    monkeypatch.setattr(simhash, "FOREST", 16)
    assert parts([tuple(r) for r in simhash.near_links(nodes, form).collect()]) == whole
    assert len(whole) == 400 and len(set(whole.values())) <= 40


def test_lean_lets_go():
    common.KEPT["x"] = 1
    rows = list(common.lean(lambda batches: batches)(iter([pa.RecordBatch.from_pydict({"a": [1]})])))
    assert len(rows) == 1 and not common.KEPT

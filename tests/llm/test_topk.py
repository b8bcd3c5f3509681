import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, row int, side string"


def brute(rows, k, asks):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if asks(i):
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(good) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=20, of=5):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % of == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seeds", [8, 4096])
def test_top_k_is_exact(spark, monkeypatch, seeds):
    """Clusters, a vector that a third of the rows repeat, ties, nulls, non-finite components, a repeated id, a short vector."""
    for name, value in (("SEEDS", seeds), ("ROWS", 64), ("QUERIES", 32), ("CHUNK", 16), ("GROUP", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 21)) * 0.3 + rng.normal(size=(6, 21))[rng.integers(0, 6, 300)]
    x[::3] = x[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (405, [1.0, None] + [0.0] * 19), (410, [float("nan")] * 21), (415, [float("inf")] + [0.0] * 20), (None, rows[1][1]),
             (10, rows[7][1]), (500, [1.0, -2.0, 0.5]), (505, [])]
    assert run(spark, rows) == brute(rows, 20, lambda i: i % 5 == 0)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (5, [-1.0, 0.0]), (7, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, 20, lambda i: i % 5 == 0)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == [] and run(spark, []) == []


def test_large_components_are_exact(spark):
    """Scores beyond 2^53 leave doubles for integers."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-(1 << 22), 1 << 22, 9)).astype(np.float32).tolist()) for i in range(40)]
    assert run(spark, rows, 7) == brute(rows, 7, lambda i: i % 5 == 0)


def test_bounds_drop_candidates():
    """Survivors shrink block by block, and what is dropped can't be among the best."""
    rng = np.random.default_rng(2)
    x = np.floor(64 * (rng.normal(size=(3000, 40)) * np.linspace(3, 0.1, 40))).astype(np.int64)
    best = topk.search(x[:20], np.arange(20), np.full(20, -np.inf), x, np.arange(3000), np.arange(3000), 5)
    s = x[:20] @ x.T
    s[np.arange(20), np.arange(20)] = -(1 << 60)
    for i in range(20):
        want = sorted(zip(-s[i], range(3000)))[:5]
        assert list(zip((-best.found[i][0]).tolist(), best.found[i][1].tolist())) == want

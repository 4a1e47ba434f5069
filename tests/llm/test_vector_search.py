"""Top-k against brute force, with ties, odd rows and very large values."""
import math
import random

import numpy as np
from pyspark.sql import functions as F

from cardlens.llm import vector_search as vs


def brute(rows, k, asks):
    good = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, v in good:
        if asks(i):
            best = {(-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v)}
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(best)[:k])}
    return out


def run(spark, rows, k=5):
    frame = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, id int")
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vs.top_k(frame, F.col("vec_id") % 5 == 0, k).collect()}


def test_random_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vs, "BLOCK_VECTORS", 60)
    monkeypatch.setattr(vs, "BLOCK_QUERIES", 20)
    r = random.Random(1)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(200)] + rows[:30]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 5 == 0)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (25, []), (30, [1.0]), (1, [-1.0, 0.25]), (2, [1.0, 2.0, 3.0]), (35, [])]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 5 == 0)
    assert run(spark, []) == set()


def test_large_values(spark):
    rows = [(i, [float(np.float32(10.0 ** i)), float(np.float32(-3.0 * i))]) for i in range(7)]
    assert run(spark, rows, 3) == brute(rows, 3, lambda i: i % 5 == 0)


def test_reads_few_exact_vectors():
    random = np.random.default_rng(3)
    vectors = np.floor(random.normal(0, 60, (5000, 16)))
    file = vs.ApproximationFile(vectors)
    low, high = file.bounds(vectors[:20])
    exact = vectors[:20] @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    for i in range(20):
        best, read = file.search(vectors[i], np.arange(5000), i, low[i], high[i], 5)
        assert read < 1000
        others = np.delete(np.arange(5000), i)
        assert [b[0] for b in best] == sorted(exact[i, others].astype(int).tolist(), reverse=True)[:5]

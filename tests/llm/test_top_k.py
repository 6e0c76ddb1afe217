import math

import numpy as np
from pyspark.sql import functions as F
from sitelens.llm import queries, top_k


def brute(rows, queries_of, k, scale=64):
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in sound:
        if queries_of(i):
            cut = lambda s: max(1 - 2**63, min(2**63 - 1, s))
            scores = sorted((-cut(sum(a * b for a, b in zip(q, c))), j) for j, c in sound if j != i and len(c) == len(q))
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)}
    return out


def test_matches_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op9_exact_top_k(spark, sf)
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 20 == 0, 20)


def test_bounds_leave_candidates_out_and_ties_go_to_the_smaller_id():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1000, (20, 8))
    c = np.rint(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 8))).astype(np.int64)
    c[1] = c[0]
    ids = np.arange(4000)
    x = c.astype(float)
    table = top_k.to_pivots(x, x[:24])
    for query, best, scores, evaluated in top_k.search(ids[:5], x[:5], table[:5], np.full(5, -np.inf), ids, x, table, x[:24], 10):
        exact = c @ c[query]
        want = sorted((-int(s), int(i)) for i, s in enumerate(exact) if i != query)[:10]
        assert [(-int(s), int(i)) for i, s in zip(best, scores)] == want and evaluated < len(c) / 4


def test_a_known_score_leaves_more_out_and_changes_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 40, (3000, 6)))
    ids, table = np.arange(3000), top_k.to_pivots(x, x[:24])
    run = lambda known: list(top_k.search(ids[:20], x[:20], table[:20], known, ids, x, table, x[:24], 5))
    free = run(np.full(20, -np.inf))
    tight = run(np.array([f[2][-1] for f in free], float))
    assert all((a[1] == b[1]).all() and b[3] <= a[3] for a, b in zip(free, tight)) and sum(f[3] for f in tight) < 20 * 3000


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(top_k, "VECTOR_BLOCK", 150)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 5).round(1).tolist()) for i in range(700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in top_k.exact_top_k(frame, F.col("vec_id") % 20 == 0, k=6).collect()} == brute(rows, lambda i: i % 20 == 0, 6)


def test_very_large_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    for size in (1e3, 1e9, 3e15, 1e35):
        rows = [(i, (rng.normal(0, 10, 4) * (size if i % 37 == 0 else 1)).tolist()) for i in range(400)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {tuple(r) for r in top_k.exact_top_k(frame, F.col("vec_id") % 20 == 0, k=5).collect()}
        assert got == brute(rows, lambda i: i % 20 == 0, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (20, [1.0, -2.0], 1), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (40, [1.0, 2.0, 3.0], 1), (60, [0.01, -0.01], 1), (7, [5.0, 5.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    got = top_k.exact_top_k(frame, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert 40 not in by and sorted(by) == [0, 20, 60]
    assert [x[1] for x in sorted(by[20])] == [60, 0, 0, 7] or sorted(x[1] for x in by[20]) == [0, 0, 7, 60]
    assert top_k.exact_top_k(frame.limit(0), F.lit(True)).collect() == []

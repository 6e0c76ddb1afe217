import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F
from sitelens.llm import hard_negatives, queries
from tests import oracle


def brute(rows, is_anchor, positives=5, negatives=10, scale=256):
    sound = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda s: max(1 - 2**63, min(2**63 - 1, s))
    out = set()
    for i, a, c in sound:
        if is_anchor(i):
            scores = sorted((-cut(sum(x * y for x, y in zip(a, b))), j, d) for j, b, d in sound if j != i and len(b) == len(a))
            for s, j in [(-s, j) for s, j, d in scores if d == c][:positives]:
                fit = [(-n, m) for n, m, d in scores if d != c and Fraction(30 * s) <= 100 * -n <= 90 * s]
                out |= {(i, j, r, m, s, n) for r, (n, m) in enumerate(fit[:negatives], 1)}
    return out


def result(frame):
    return {tuple(r) for r in frame.drop("place").collect()}


def frame_of(spark, rows, label="int"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {label}")


def test_sql_on_larger_tables(spark):
    sf = "/root/testdata/sf0.1"
    assert oracle.compare(queries.op13_hard_negatives(spark, sf), oracle.connect(sf), queries.ORACLE_SQL["op13_hard_negatives"]) is None


def test_several_blocks_ties_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "HELD", 900)
    monkeypatch.setattr(hard_negatives, "ASKED", 60)
    monkeypatch.setattr(hard_negatives, "MEMBERS", 3)
    monkeypatch.setattr(hard_negatives, "FIRST", 16)
    rng = np.random.default_rng(5)
    # few different values: many ties; a third of the rows in one label, and one vector over and over
    rows = [(i, [0.5] * 6 if i % 9 == 0 else (rng.integers(-3, 4, 6) / 4).tolist(), 0 if i % 3 == 0 else int(rng.integers(1, 6))) for i in range(900)]
    got = hard_negatives.hard_negatives(frame_of(spark, rows), F.col("vec_id") % 20 == 0, F.col("label"), scale=4)
    want = brute(rows, lambda i: i % 20 == 0, scale=4)
    assert result(got) == want and len(want) > 1000


def test_the_walk_ends_early_where_there_are_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1000, (20, 16))
    of = rng.integers(0, 20, 6000)
    x = np.rint(centres[of] + rng.normal(0, 20, (6000, 16)))
    ids, labels = np.arange(6000), of % 3
    members = np.flatnonzero(of == 4)[:30]
    centre = hard_negatives.fit(x[members])[0]
    whole = [[(-(2**63), 2**63 - 1)] for _ in members]
    for anchor, _, best, scores, evaluated in hard_negatives.walk(ids[members], x[members], labels[members], whole, ids, x, labels, False, centre, 5):
        want = sorted((-int(x[anchor] @ x[j]), j) for j in range(6000) if labels[j] == labels[anchor] and j != anchor)[:5]
        assert [(-int(s), int(j)) for j, s in zip(best, scores)] == want and evaluated < 2000


def test_bounds_hold_for_all_members():
    rng = np.random.default_rng(2)
    c, a = np.floor(rng.normal(0, 300, (500, 5))), np.floor(rng.normal(0, 300, (40, 5)) + 200)
    c[3] = 0
    order, bound = hard_negatives.shared_list(c, a, hard_negatives.fit(a)[0])
    assert ((a @ c[order].T) <= np.linalg.norm(a, axis=1)[:, None] * bound + 1e-3).all() and (np.diff(bound) <= 0).all()


def test_very_large_vectors(spark):
    rng = np.random.default_rng(3)
    for size in (1e3, 1e9, 3e15, 1e35, 1e200):
        rows = [(i, (rng.normal(0, 10, 4) * (size if i % 37 == 0 else 1)).tolist(), int(rng.integers(0, 3))) for i in range(300)]
        got = hard_negatives.hard_negatives(frame_of(spark, rows), F.col("vec_id") % 20 == 0, F.col("label"))
        assert result(got) == brute(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "a"), (1, [1.0, 1.0], "a"), (2, [0.5, 0.5], "b"), (2, [0.5, 0.5], "b"), (3, None, "b"), (4, [1.0, None], "b"), (5, [nan, 1.0], "b"), (6, [inf, 0.5], "b"), (None, [0.5, 0.5], "b")]
    rows += [(7, [0.5, 0.5], None), (8, [0.5, 0.5, 0.5], "b"), (9, [], "a"), (20, [], "a"), (21, [], "b"), (40, [-1.0, -1.0], "a"), (60, [0.0, 0.0], "c"), (80, [9.0, 9.0], "d")]
    clash = {k: F.lit(1) for k in ("id", "size", "part", "group", "place", "rank", "low", "high", "score", "cluster")}
    frame = frame_of(spark, rows, "string").withColumns(clash)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0, F.col("label"))
    # 0 takes 1 as its positive (score 3 * 256**2), of which the repeated 2 is half; empty vectors score 0 with each other
    assert {tuple(r) for r in got.where("anchor_id = 0").drop("place").collect()} == {(0, 1, 1, 2, 196608, 98304), (0, 1, 2, 2, 196608, 98304)}
    assert {tuple(r) for r in got.where("anchor_id = 20").drop("place").collect()} == {(20, 9, 1, 21, 0, 0)}
    assert {r.anchor_id for r in got.collect()} == {0, 20}  # 40 has negative scores only, 60 and 80 no positive
    assert hard_negatives.hard_negatives(frame.limit(0), F.lit(True), F.col("label")).collect() == []

import hashlib
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F
from sitelens.llm import periodic, queries


def brute(words, least=12):
    """All runs, period by period: stretches where words equal those a period later, save those with a smaller period."""
    w, found = np.array([hash(x) for x in words], np.int64), []
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = e - s + q
            if length >= max(least, 2 * q) and not any(a <= s and s + length <= a + b and c < q for a, b, c in found):
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def digests(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def ids(words):
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array([numbers[w] for w in words], np.int64)


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    want = {digests(r.doc_id, r.text) for r in docs}
    assert got == want and sum(r[1] > 0 for r in want) > 10


def test_all_runs_of_short_texts():
    rng = np.random.default_rng(1)
    for k in range(3000):
        words = rng.integers(0, 2 + k % 3, rng.integers(0, 60)).tolist()
        if k % 2 and words:
            words = words * 2 + [9] + words[: len(words) // 2] * 3
        least = (4, 5, 12)[k % 3]
        assert periodic.runs_of(ids(words), least) == brute(words, least), words


def test_ordered_sets_in_many_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 4)
    rng = np.random.default_rng(2)
    for _ in range(50):
        words = rng.integers(0, 2, 400).tolist()
        assert periodic.runs_of(ids(words)) == brute(words)
    held = periodic.Ordered(500)
    for x in rng.permutation(1000).tolist():
        if x != 500:
            held.add(x)
    assert list(held) == list(range(1000)) and max(map(len, held.pieces)) <= 4


def test_fibonacci_and_thue_morse():
    a, b = "0", "01"
    while len(b) < 2000:
        a, b = b, b + a
    t = "".join(str(bin(i).count("1") % 2) for i in range(2048))
    for words in (b, t):
        assert periodic.runs_of(ids(words)) == brute(words)


def test_very_long_texts_take_time_in_proportion():
    rng = np.random.default_rng(3)
    one = ["lorem", "ipsum", "dolor", "sit", "amet"] * 40000
    mostly = ["0" if x else "1" for x in rng.random(200000) > 0.002]
    for words in (one, ["x"] * 200000, mostly, rng.integers(0, 2, 200000).tolist()):
        began = time.time()
        runs = periodic.runs_of(ids(words))
        assert runs and time.time() - began < 30
    assert periodic.runs_of(ids(one)) == [(0, 200000, 5)]


def test_odd_rows(spark, odd, none):
    out = periodic.periodic_runs(odd.withColumn("periodic", F.lit(1)))
    assert out.columns == [*odd.columns, "periodic"] and out.count() == odd.count()
    by = {r.doc_id: r.periodic for r in out.collect()}
    for blank in (2, 3, 4):
        assert by[blank] == (0, [], "")
    assert by[6] == (1, [], "one") and [tuple(r) for r in by[8].runs] == [(0, 100000, 5)] and by[8].collapsed == "lorem ipsum dolor sit amet"
    assert by[9].n_words == 100001 and by[9].collapsed == "lorem ipsum dolor sit amet end"
    assert periodic.periodic_runs(none).collect() == []


def test_neighbouring_runs_and_what_they_keep(spark):
    text = "x " + "a b c " * 5 + "a\tb z\n" + "q " * 12 + "end of it"
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().periodic
    assert [tuple(r) for r in row.runs] == [(1, 17, 3), (19, 12, 1)] and row.collapsed == "x a b c z q end of it"

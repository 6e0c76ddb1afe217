from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql import functions as F
from sitelens.llm import mix, queries


def fill(budget, nodes):
    """Shares of (name, capacity, weight) by plain rounds of filling."""
    out = {n: 0.0 for n, _, _ in nodes}
    open_ = [n for n in nodes if n[2] > 0]
    while open_ and budget > 1e-9:
        level = min([(c - out[n]) / w for n, c, w in open_] + [budget / sum(w for _, _, w in open_)])
        for n, _, w in open_:
            out[n] += w * level
        budget -= level * sum(w for _, _, w in open_)
        open_ = [(n, c, w) for n, c, w in open_ if c - out[n] > 1e-9]
    return out


def brute(rows, levels, weights, share, epochs, seed="0"):
    """rows: (id, path, tokens); Counter of (id, epoch)."""
    leaves, docs = Counter(), defaultdict(list)
    for i, path, n in rows:
        leaves[path] += n
        docs[path].append((i, n))
    budget = {(): min(sum(leaves.values()) * share, sum(leaves.values()) * epochs)}
    for d in range(levels):
        nodes = Counter()
        for path, n in leaves.items():
            nodes[path[: d + 1]] += n * epochs
        for parent in {p[:d] for p in nodes}:
            budget |= fill(budget[parent], [(p, c, weights[d].get(p[-1], 1)) for p, c in nodes.items() if p[:d] == parent])
    out = Counter()
    for path, total in leaves.items():
        full = min(epochs, int((budget[path] + 1e-6) // total)) if total else 0
        for e in range(full):
            out.update((i, e) for i, _ in docs[path])
        rest = int(budget[path] + 1e-6 - full * total) if full < epochs else 0
        order = sorted((int(md5(f"{seed}-{full}-{'' if i is None else i}".encode()).hexdigest()[:15], 16), str(i), i, n) for i, n in docs[path])
        for _, _, i, n in order if rest > 0 else ():
            if (rest := rest - n) < 0:
                break
            out[i, full] += 1
    return out


def test_matches_brute_force(spark, sf, documents):
    rows = [(i, (f"d{int(r.source[3:]) % 3}", r.lang, r.source), len((r.text or "").split())) for i, r in documents.items()]
    want = brute(rows, 3, [queries.WEIGHTS["domain"], queries.WEIGHTS["lang"], {}], 0.8, 3)
    got = Counter((r.doc_id, r.epoch) for r in queries.op7_source_mix(spark, sf).collect())
    assert got == want and max(e for _, e in got) > 0


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "p string, q string, tokens long")
    got = {r.q: r.budget for r in mix.budgets(leaves, ["p", "q"], {}, 0.5, 1).collect()}
    assert got["x"] == 10 and abs(got["y"] - 492.5) < 1e-6 and abs(got["z"] - 502.5) < 1e-6
    got = {r.q: r.budget for r in mix.budgets(leaves.where("q <> 'y'"), ["p", "q"], {"p": {"a": 9}}, 0.5, 1).collect()}
    assert got["x"] == 10 and abs(got["z"] - 495) < 1e-6


def test_odd_rows(odd, none):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mix.mix(odd, levels, {}, share=1.0, epochs=1, into="mixed")
    assert got.columns == odd.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids[8] == 1 and ids[7] == 2 and ids[None] == 1
    assert mix.mix(odd, levels, {"lang": {"en": 0}}, share=1.0).where("lang = 'en'").count() == 0
    assert mix.mix(none, levels, {}).collect() == []

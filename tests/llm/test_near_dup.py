import re
from collections import Counter, defaultdict

from sitelens.llm import near_dup, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(texts, size):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    holders, both, parent = defaultdict(list), Counter(), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for s in sets[i]:
            both.update((j, i) for j in holders[s])
            holders[s].append(i)
    for (i, j), n in both.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def test_matches_brute_force(spark, sf, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_minhash_near_dup(spark, sf).collect()}
    assert got == brute({i: r.text for i, r in documents.items()}, 4)


def test_chain_is_one_component_though_its_ends_differ(spark):
    words = [f"w{k}" for k in range(200)]
    # each text changes words that the next also lacks: neighbours are similar, the ends are not
    texts = {k: " ".join(words[12 * k : 12 * k + 140]) for k in range(5)}
    # a pivot that is similar to no text of a bucket must not hide the links of the others
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(rows, size=4).collect()}
    assert got == brute(texts, 4) and {c for _, c, _ in got.values()} == {0}


def test_large_groups_of_near_copies(spark):
    base = [f"w{k}" for k in range(120)]
    texts = {k: " ".join([*base[: k % 100], f"x{k}", *base[k % 100 + 1 :]]) for k in range(300)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dup.near_duplicates(rows, size=4).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd, size=4).collect()]
    assert len(got) == 13
    by = {g[0]: g[1:] for g in got}
    assert by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[4] == (0, 4, True)
    assert by[7] == (1, 6, False) and by[None][1:] == (None, True) and by[9][1:] == (8, False)
    assert near_dup.near_duplicates(none).collect() == []
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 6, None, 8, 10], key=str)


def test_random_groups_around_the_threshold(spark):
    import random

    rng, texts = random.Random(11), {}
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(90)]
        for k in range(40):
            words = list(rng.choice([base, texts.get(f"{group}", base)]))
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(["the", "of", f"x{rng.randrange(30)}"])
            if rng.random() < 0.3:
                words = words[rng.randrange(12) :]
            texts[f"{group}"] = words
            texts[1000 * group + k + 1] = " ".join(words)
    texts = {i: t for i, t in texts.items() if isinstance(i, int)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(rows, size=4).collect()}
    want = brute(texts, 4)
    assert got == want and 20 < len({c for _, c, _ in want.values()}) < 200

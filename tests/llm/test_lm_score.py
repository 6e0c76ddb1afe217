import math
import re
from collections import Counter

import pytest
from sitelens.llm import lm_score, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, order=2, backoff=0.4, least=1, model=None):
    split = lambda texts: [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts]
    words = split(texts)
    counted = words if model is None else split(model)
    counts = Counter(tuple(w[k : k + n]) for w in counted for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(map(len, counted))
    out = []
    for w in words:
        score = 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    score += math.log10(counts[gram] / total)
                elif counts[gram] >= least:
                    score += math.log10(counts[gram] / counts[gram[:-1]])
                    break
                else:
                    score += math.log10(backoff)
        out.append((len(w), score))
    return out


def test_matches_brute_force(spark, sf, documents):
    ids = sorted(documents)
    want = dict(zip(ids, brute([documents[i].text for i in ids])))
    got = queries.op8_stupid_backoff(spark, sf).collect()
    assert len(got) == len(ids)
    for r in got:
        assert r.n_words == want[r.doc_id][0] and abs(r.log10_score - want[r.doc_id][1]) < 1e-3


@pytest.mark.parametrize("frequent", [0, 3, 1000])
@pytest.mark.parametrize("least", [1, 2])
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders(spark, order, least, frequent):
    texts = ["a b c d", "a b c e", "", "x", "a b", "b c d a b c d"]
    got = lm_score.stupid_backoff(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order=order, min_count=least, frequent=frequent)
    for r, (n, score) in zip(sorted(got.collect()), brute(texts, order, least=least)):
        assert r.n_words == n and abs(r.log10_score - score) < 1e-9


def test_model_of_other_texts_backs_off(spark):
    model, texts = ["a b c d e", "b c d c e", "e a"], ["a b c e", "e d c b a", "a", "", "c d z a b z"]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.stupid_backoff(frame(texts), order=3, model=frame(model)).collect()}
    want = brute([t.replace("z", "") for t in texts[:4]], 3, model=model)
    for i, (n, score) in enumerate(want):
        assert got[i].n_words == n and got[i].n_unknown == 0 and abs(got[i].log10_score - score) < 1e-9
    assert got[4].n_words == 6 and got[4].n_unknown == 2


def test_odd_rows(odd, none):
    rows = odd.collect()
    want = brute([r.text for r in rows])
    got = sorted(lm_score.stupid_backoff(odd).collect(), key=str)
    expected = sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=lambda t: str(t[0]))
    for i in {r.doc_id for r in rows}:
        assert sorted(r.n_words for r in got if r.doc_id == i) == sorted(e[1] for e in expected if e[0] == i)
        assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(sorted(r.log10_score for r in got if r.doc_id == i), sorted(e[2] for e in expected if e[0] == i)))
    assert lm_score.stupid_backoff(none).collect() == []


def test_trigrams_match_brute_force(spark, sf, documents):
    ids = sorted(documents)
    want = dict(zip(ids, brute([documents[i].text for i in ids], order=3, least=2)))
    got = queries.QUERIES["op8_stupid_backoff_3"](spark, sf).collect()
    assert len(got) == len(ids)
    for r in got:
        assert r.n_words == want[r.doc_id][0] and abs(r.log10_score - want[r.doc_id][1]) < 1e-3

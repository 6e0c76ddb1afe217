import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sitelens.llm import packing, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(pieces, texts, window=4096):
    """The contract: each row's ids lie in exactly one piece each, and only powers of two are short. texts: by doc_id, none repeated."""
    ids = {d: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.length > 0 and p.doc_tokens == len(own) and p.ids_crc32 == crc(own[p.start : p.start + p.length])
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert by_doc.keys() == ids.keys() and sorted(by_sequence) == list(range(len(by_sequence)))
    for d, of in by_doc.items():
        assert [s for s, _ in sorted(of)] == np.cumsum([0, *(n for _, n in sorted(of))])[:-1].tolist() and sum(n for _, n in of) == len(ids[d])
    short = []
    for of in by_sequence.values():
        total = sum(n for _, n in of)
        assert [s for s, _ in sorted(of)] == np.cumsum([0, *(n for _, n in sorted(of))])[:-1].tolist() and total <= window
        if total < window:
            assert total & (total - 1) == 0
            short.append(total)
    assert len(short) == len(set(short))
    return ids, by_doc, by_sequence


def test_query(spark, sf, documents):
    pieces = queries.op11_packing(spark, sf).collect()
    ids, by_doc, _ = check(pieces, {d: r.text for d, r in documents.items()})
    # most documents are whole but for cuts at windows
    assert sum(len(of) <= -(-len(ids[d]) // 4096) for d, of in by_doc.items()) > 0.6 * len(ids)


def test_many_lengths_and_small_windows(spark):
    rng = np.random.default_rng(1)
    texts = {i: " ".join(["a"] * int(n)) for i, n in enumerate([*rng.integers(0, 300, 3000), *[40] * 1500, *[63] * 500, *[64] * 300, 70000])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    tokens = packing.tokenise(docs, PATH, window=128, steps=32)
    pieces = packing.pack(tokens, window=128, steps=32).collect()
    _, by_doc, _ = check(pieces, texts, 128)
    assert sum(len(of) == -(-sum(n for _, n in of) // 128) for of in by_doc.values()) > 0.8 * len(by_doc)


def test_sequences_hold_the_packed_ids(spark):
    texts = {i: f"word{i} and more " * (i % 50) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokens = packing.tokenise(docs, PATH, window=256, steps=32)
    pieces = packing.pack(tokens, window=256, steps=32)
    made = packing.sequences(tokens, pieces).collect()
    at = {r.sequence_id: r for r in made}
    ids, _, by_sequence = check(pieces.collect(), texts, 256)
    for p in pieces.collect():
        assert at[p.sequence_id].ids[p.offset : p.offset + p.length] == ids[p.doc_id][p.start : p.start + p.length]
    assert all(at[s].lengths == [n for _, n in sorted(of)] for s, of in by_sequence.items())
    assert Counter(x for r in made for x in r.ids) == Counter(x for own in ids.values() for x in own)


@pytest.mark.parametrize("texts", [[], [None], ["", ""], ["a " * 4095], ["a " * 4096], ["a " * 9000, ""], ["a " * 2000] * 3])
def test_few_rows(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.pack(packing.tokenise(docs, PATH)).collect(), dict(enumerate(texts)))


def test_odd_rows(spark, odd, none):
    tokens = packing.tokenise(odd.withColumns({"part": F.lit(1), "rest": F.lit("x"), "bin": F.lit(2)}), PATH)
    pieces = packing.pack(tokens).collect()
    rows = defaultdict(int)
    for p in pieces:
        rows[p.part, p.at] += p.length
    n = {(r.part, r.at): r.n_tokens for r in tokens.collect()}
    assert rows == n and len(n) == odd.count() and sum(p.doc_id is None for p in pieces) >= 1
    assert packing.pack(packing.tokenise(none, PATH)).collect() == []


def test_words_are_encoded_as_in_their_texts(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 20)
    monkeypatch.setattr(packing, "PARTS", 20)
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    for text in ["", " \n\t ", "It's DON'T 12ab--c,d  x", "Straße ÑANDÚ ça été　日本語 \U0001f600", "é a ́b \x1c\x85c", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ΟΔΟΣ İx ﬁ Å e\u0301a Ǆx 豈 ǅ ﬀ", "a" * 5000] + [" ".join(f"w{i}x" for i in range(k, k + 15)) for k in range(0, 60, 9)]:
        assert next(encoder.encode(packing.pa.array([text]))).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_least_squares():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a = rng.random((6, 15))
        x = packing.least_squares(a, a @ np.maximum(0, rng.normal(0, 1, 15)) + rng.normal(0, 0.1, 6))
        assert (x >= 0).all()
    a, want = np.eye(4), np.array([1.0, 0, 2, 0])
    assert np.allclose(packing.least_squares(a, np.array([1.0, -3, 2, -1])), want)
    b = rng.normal(0, 1, 6)
    x = packing.least_squares(rng.random((6, 3)), -np.abs(b))
    assert (x == 0).all()


def test_repeats_use_no_length_too_often():
    rng = np.random.default_rng(5)
    histogram = rng.integers(0, 1000, 128)
    rows, times = packing.repeats(histogram, histogram * (np.arange(128) * 32 + 17))
    assert (times @ rows <= histogram).all() and (rows @ np.arange(1, 129) == 128).all() and (times @ rows).sum() > 0.75 * histogram.sum()

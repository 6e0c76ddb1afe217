import numpy as np
import tiktoken
from sitelens.llm import queries, token_count
from tiktoken.load import load_tiktoken_bpe


def test_counts_match_the_tokenizer(spark, sf, documents):
    ranks = load_tiktoken_bpe(token_count.VOCABULARY)
    encoding = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, sf).collect()}
    assert got == {i: len(encoding.encode_ordinary(r.text or "")) for i, r in documents.items()}


def test_documents_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    end, want = token_count.END_OF_DOCUMENT, set()
    for name, closed in (("x.bin", True), ("y.bin", False)):
        lengths = rng.integers(0, 40, 50)
        at, ids = 0, []
        for k, n in enumerate(lengths):
            want.add((name, k, at, int(n)))
            at += int(n) + 1
            ids += [*rng.integers(0, 50000, n), end]
        if not closed:
            want.add((name, 50, at, 7))
            ids += [1] * 7
        np.array(ids, "<u2").tofile(tmp_path / name)
    (tmp_path / "empty.bin").touch()
    for block in (2, 6, 64, 1 << 20):
        got = token_count.scan_token_files(spark, f"file://{tmp_path}", block_bytes=block)
        assert {(r.file, r.ordinal, r.start, r.n_tokens) for r in got.collect()} == want


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.n_tokens) for r in token_count.count_tokens(odd).collect()]
    assert len(got) == 13 and (2, 0) in got and (3, 0) in got and got.count((7, 1)) == 2
    assert token_count.count_tokens(none).collect() == []

import hashlib
import re

import pytest
from sitelens.llm import decontaminate, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, benchmark, size=13):
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    items |= found
        names = sorted(str(i) for i in items)
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_matches_brute_force(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_decontaminate(spark, sf).collect()}
    want = brute([(i, r.text) for i, r in documents.items()], items)
    assert got == want and any(w[4] for w in want.values())


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_blocks_offsets_and_odd_items(spark, odd, none, block_bytes):
    benchmark = spark.createDataFrame([(1, "The log, and BARKED"), (1, "The log, and BARKED"), (2, "größer ñandú"), (3, None), (4, "..."), (None, "sat on the mat"), (5, "one"), (6, "x" * 500)], "item_id long, text string")
    got = decontaminate.benchmark_hits(odd.drop("hits"), benchmark, block_bytes=block_bytes).select("doc_id", "text", "hits").collect()
    assert len(got) == 13
    by = {r.doc_id: r for r in got}
    assert by[0].hits["items"] == ["", "1"] and by[7].hits.contaminated and by[2].hits.n_words == 0 and not by[8].hits.contaminated
    assert sorted(by[0].text[s.start : s.stop] for s in by[0].hits.spans) == ["sat on the mat", "the log and barked"]
    assert [by[10].text[s.start : s.stop] for s in by[10].hits.spans] == ["größer ñandú"]
    kept = decontaminate.drop_contaminated(odd, benchmark, block_bytes=block_bytes)
    assert kept.columns == odd.columns and kept.where("doc_id in (6, 7)").count() == 0 and kept.count() < 13
    assert decontaminate.benchmark_hits(none, benchmark).collect() == []
    assert decontaminate.drop_contaminated(odd, benchmark.limit(0)).count() == 13


def test_blocks_give_what_one_automaton_gives(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    def hits(**bound):
        found = decontaminate.benchmark_hits(docs, items, **bound).select("doc_id", "hits.*").collect()
        return {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated, [tuple(s) for s in r.spans]) for r in found}

    assert hits() == hits(block_bytes=100_000)

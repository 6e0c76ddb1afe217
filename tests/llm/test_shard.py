import zlib
from hashlib import md5

import pytest
from sitelens.llm import queries, shard


def brute(rows, shards, tolerance=0.01):
    """Rows in key order, cut after the row that reaches each target, or at a near border of its group."""
    order = sorted((int(md5((t or "").encode()).hexdigest()[:15], 16), -(1 << 63) if i is None else i, len((t or "").encode()) + 1) for i, t in rows)
    total, at, spans, groups = sum(r[2] for r in order), 0, [], {}
    for h, _, size in order:
        spans.append((at, at + size))
        groups[h] = (groups.get(h, (at, 0))[0], at + size)
        at += size
    cuts = []
    for target in (-(-i * total // shards) for i in range(1, shards)):
        k = next(k for k, (a, b) in enumerate(spans) if a < target <= b)
        first, last = groups[order[k][0]]
        near = first if target - first <= last - target else last
        cuts.append(near if abs(near - target) <= int(total * tolerance / shards) else spans[k][1])
    out, slots = {}, {}
    for (h, i, size), (a, _) in zip(order, spans):
        s = sum(c <= a for c in cuts)
        out[h, i] = (size, s, slots.get(s, 0))
        slots[s] = slots.get(s, 0) + 1
    return out


def test_matches_brute_force(spark, sf, documents):
    got = queries.op4_histogram_shards(spark, sf).collect()
    want = brute([(i, r.text) for i, r in documents.items()], 16)
    assert len(got) == len(documents)
    for r in got:
        text = documents[r.doc_id].text or ""
        assert r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes" and r.grown_shard is None
        assert (r.size, r.shard, r.slot) == want[int(md5(text.encode()).hexdigest()[:15], 16), r.doc_id]


@pytest.mark.parametrize("piece_bytes", [1 << 20, 700])
def test_hot_text_is_parted_and_slots_have_no_gaps(spark, piece_bytes):
    rows = [(k, "the same text again and again") for k in range(600)] + [(k, f"text {k}" * (k % 9)) for k in range(600, 1200)]
    got = shard.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, piece_bytes=piece_bytes).collect()
    by = {}
    for r in got:
        by.setdefault(r.placed.shard, []).append(r.placed)
    assert sorted(by) == [0, 1, 2, 3]
    sizes = [sum(p["size"] for p in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 74
    assert all(sorted(p.slot for p in v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("piece_bytes", [1 << 20, 3000])
def test_equal_texts_stay_whole_within_the_tolerance(spark, piece_bytes):
    rows = [(k, f"text {k // 7} " * 3) for k in range(7000)]
    got = shard.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, piece_bytes=piece_bytes).collect()
    sizes = [sum(r.placed["size"] for r in got if r.placed.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 4
    assert len({(r.text, r.placed.shard) for r in got}) == 1000
    for s in range(4):
        assert sorted(r.placed.slot for r in got if r.placed.shard == s) == list(range(sum(r.placed.shard == s for r in got)))


@pytest.mark.parametrize("rows", [[(k, f"text {k // 11} " * 3) for k in range(3000)], [(k, "x" * (9000 if k == 7 else k % 13)) for k in range(400)]])
def test_shards_do_not_depend_on_the_pieces(spark, rows):
    want = brute(rows, 4, 0.05)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for piece_bytes in (1 << 20, 3000, 150):
        got = shard.shard(docs, shards=4, tolerance=0.05, piece_bytes=piece_bytes).collect()
        assert {(int(md5(r.text.encode()).hexdigest()[:15], 16), r.doc_id): (r.placed["size"], r.placed.shard, r.placed.slot) for r in got} == want


def test_odd_rows(odd, none):
    got = shard.shard(odd, shards=4).collect()
    assert len(got) == 13 and {r.placed.shard for r in got} <= {0, 1, 2, 3}
    for s in range(4):
        own = sorted(r.placed.slot for r in got if r.placed.shard == s)
        assert own == list(range(len(own)))
    assert {r.placed["size"] for r in got if r.doc_id in (2, 3)} == {1}
    assert shard.shard(none).collect() == []


def test_written_shards(spark, odd, tmp_path):
    shard.write_shards(shard.shard(odd.select("doc_id", "text"), shards=2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13

from collections import Counter

import corpus_pipeline
from sitelens.llm import queries
from tests.llm import test_decontaminate, test_mix, test_near_dup, test_shard


def test_stages_match_brute_force(spark, sf, documents):
    texts = {i: r.text for i, r in documents.items() if any(c.isalpha() for c in r.text or "")}
    texts = {i: texts[i] for i, (_, _, kept) in test_near_dup.brute(texts, 5).items() if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = test_decontaminate.brute(texts.items(), items)
    texts = {i: t for i, t in texts.items() if not found[i][4]}
    rows = [(i, (f"d{int(documents[i].source[3:]) % 3}", documents[i].lang, documents[i].source), len(t.split())) for i, t in texts.items()]
    chosen = test_mix.brute(rows, 3, [queries.WEIGHTS["domain"], queries.WEIGHTS["lang"], {}], 0.8, 1)
    want = test_shard.brute([(i, texts[i]) for i, _ in chosen], 16)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(i for _, i in want) == sorted(r.doc_id for r in got)
    assert {(i, *v) for (_, i), v in want.items()} == {(r.doc_id, r["size"], r.shard, r.slot) for r in got}


def test_stages_keep_the_columns_of_documents(spark, sf, odd):
    docs = odd.select("doc_id", "text", "lang", "source").withColumn("n_chars", odd.doc_id)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, sf)
            assert out.columns == docs.columns and out.count() <= frame.count()


def test_stages_on_columns_with_names_of_their_own(spark, sf, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.agg({"component_id": "min", "mixed": "max"}).first()[0] == 9
    kept = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, sf).collect())
    assert kept[6] == 1 and kept[7] == 0 and kept[None] == 1 and {2, 3, 4} <= set(kept)


def test_sharding_takes_every_row(spark, sf, odd):
    out = corpus_pipeline.sharded(spark, odd, sf)
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.shard < 16 for r in rows) and {r["size"] for r in rows if r.doc_id in (2, 3)} == {1}
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert corpus_pipeline.sharded(spark, odd.limit(0), sf).collect() == []


def test_text_in_no_known_language_goes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    texts = ["中国人民生活在这里，这是一个很长的句子", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem", "xqzkw vbgjt qqpz wxkj zzvq kjhg fdsx", "123 !!", None]
    strange = spark.createDataFrame([(10**9 + k, t, None, "src0") for k, t in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(strange), sf).collect()}
    assert kept == {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").collect()}

"""What shows only on larger tables, made small."""

import json
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sitelens.functions import elements, structured_data
from sitelens.operators import artifacts, crosspage, structured
from sitelens.plans import markup, more, registry  # noqa: F401
from sitelens.sources import readers
from tests import oracle

CUT = "SELECT k AS page_id, 'https://a.example.com/en/' || k AS url, '<html lang=\"en\"><head><meta charset=\"utf-8\"><title>Same &quot;cut&quot; &amp</title></head><body><h1>Same &quot;cut&quot; &amp</h1></body></html>' AS html FROM (SELECT unnest(range(1, 31)) AS k)"
MANY = "SELECT k AS page_id, 'https://a.example.com/en/' || k AS url, '' AS html FROM (SELECT unnest(range(50100)) AS k)"

#: A title on many pages, one of which is there twice, one without a URL, one without an id; and titles on pages of one id, or without other URLs.
ALIKE = "SELECT CASE WHEN k = 300 THEN 7 WHEN k < 400 THEN k END AS page_id, CASE WHEN k NOT IN (9, 403) THEN 'https://a.example.com/en/' || k % 350 END AS url, '<html><head><title>' || CASE WHEN k < 401 THEN 'Alike' ELSE 'Few' END || '</title></head></html>' AS html FROM (SELECT unnest(range(1, 401)) AS k) UNION ALL SELECT 500 + k * (k // 4), CASE WHEN k <> 5 THEN 'u' || k END, '<title>' || CASE WHEN k < 2 THEN 'One id' ELSE 'No other URL' END || '</title>' FROM (VALUES (0), (1), (4), (5)) v(k)"


def differs(spark, folder, name, **tables):
    import duckdb

    with duckdb.connect() as con:
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
    return oracle.compare(registry.QUERIES[name](spark, str(folder)), oracle.connect(folder), registry.ORACLE_SQL[name])


def test_a_tree_of_more_urls_than_one_sitemap_may_hold(spark, tmp_path):
    for name in ("src_6_expand_tree", "src_7_sitemap_preview"):
        assert differs(spark, tmp_path, name, pages=MANY) is None


def test_references_cut_before_their_semicolon(spark, tmp_path):
    for name in ("ext_fields", "ext_7_headings", "agg_1_duplicate_groups", "join_2_duplicate_issues", "join_7_duplicate_siblings", "join_12_carry_forward", "page_changes"):
        assert differs(spark, tmp_path, name, pages=CUT) is None
    assert elements.terminated("&amp &amp; &#65; &#65 &nonsense; &ampx; &amp;amp;") == "&amp & A &#65 &nonsense; &ampx; &amp;"
    assert elements.Page("<title>a &amp</title>").texts == [("a &", True)]  # as browsers read it, by default


def test_pages_are_read_once_a_query(spark, sf):
    most = {"ext_17_18_places": 1, "chk_all_page_checks": 0, "join_4_broken_images": 0, "join_5_redirect_chains": 0, "join_7_first_siblings": 0, "chk_45_duplicate_descriptions": 0, "sd_14_page_coverage": 0, "sd_6_validate": 0}
    for name, n in most.items():  # 0: what was read stands written
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= n, name


def test_pages_in_one_of_many_partitions_are_dealt_over_all_cores(spark, sf):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
        assert pages.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism  # all but one of them empty: the file is one row group
        assert artifacts.spread(pages).select(F.spark_partition_id()).distinct().count() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_page_of_many_links_is_no_square_of_work(spark):
    html = "<html><body><main>" + "".join(f"<p><a href='/p/{k}'>{k}</a></p>" for k in range(4000)) + "</main></body></html>"
    pages = readers.as_pages(spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string"))
    began = time.time()
    links = artifacts.extract(pages).select("links").first().links
    assert (len(links), links[3].selector) == (4000, "body > main > p:nth-of-type(4) > a")
    assert time.time() - began < 30


def test_links_are_made_once(spark, sf):
    plan = registry.QUERIES["ext_9_links"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Filter \(+size\(", plan)  # Spark's own, of pages with links


def test_the_source_of_a_heading_is_cut_without_the_whole_page():
    page = elements.Page("<h1>a" + " \n" * 900 + "b</h1><p>" + "word " * 1_000_000 + "</p><a>open " + "x " * 400)
    began = time.time()
    heading, link = page.sources().values()
    assert time.time() - began < 0.2
    assert (heading, link) == ("<h1>a b</h1>", ("<a>open " + "x " * 400)[: elements.SOURCE].strip())


def test_entities_of_small_pages_leave_python_many_at_a_time(spark):
    html = '<script type="application/ld+json">{"@type":"Offer","price":1}</script>'
    pages = pa.RecordBatch.from_pydict({"page_id": range(1000), "html": [html] * 1000})
    sizes = [b.num_rows for b in structured._extract(T.StructType.fromDDL(structured.ENTITY))(iter([pages]))]
    assert sizes == [1000]
    large = pa.RecordBatch.from_pydict({"page_id": range(8), "html": [html + " " * 600_000] * 8})
    assert len(list(structured._extract(T.StructType.fromDDL(structured.ENTITY))(iter([large])))) == 8


def test_an_entity_is_hashed_once_and_not_at_each_level(monkeypatch):
    hashed, canonical = [], structured_data.canonical
    monkeypatch.setattr(structured_data, "canonical", lambda value: hashed.append(value) or canonical(value))
    value = {"@type": "Thing", "name": "innermost"}
    for _ in range(40):
        value = {"@type": "Thing", "about": value}
    (entity,), errors = structured_data.read(f'<script type="application/ld+json">{json.dumps(value)}</script>')
    assert (len(hashed), len(structured_data.flat(entity)[0]), errors) == (1, 41, [])


def test_values_are_dealt_by_no_text_of_theirs(spark, sf):
    plan = registry.QUERIES["sd_6_validate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((bare|property|known)#\d+", plan)


def test_siblings_of_a_large_group(spark, tmp_path):
    assert differs(spark, tmp_path, "join_7_duplicate_siblings", pages=ALIKE) is None
    plan = registry.QUERIES["join_7_duplicate_siblings"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1  # no pairs, and pages are read once
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('u', id) AS url", "CASE WHEN id < 2000 THEN 'hot' ELSE concat('t', id div 2) END AS title", "CASE WHEN id < 2000 THEN 'h' ELSE concat('t', id div 2) END AS title_hash")
    tasks = {}
    for r in crosspage.duplicate_siblings(pages, "title").select("page_count", F.size("urls").alias("n"), F.spark_partition_id().alias("task")).collect():
        assert r.n == r.page_count - 1
        tasks.setdefault(r.task, []).append(r.n)
    assert sum(map(len, tasks.values())) == 3000
    assert max(n.count(1999) for n in tasks.values()) <= 500  # dealt over many tasks
    assert all(n == sorted(n, reverse=True) for n in tasks.values())  # the longest lists first

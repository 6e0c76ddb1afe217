import json

from pyspark.sql import functions as F
from sitelens.operators import crosspage, history, reports

ENTITY = "page_id int, pos int, type string, identity string, entity_hash string, properties string, rich array<struct<profile: string, status: string>>"


def entities(spark, *rows):
    return spark.createDataFrame([(1, k, t, i, json.dumps(p, sort_keys=True), json.dumps(p), [(q, s) for q, s in rich]) for k, (t, i, p, rich) in enumerate(rows)], ENTITY)


def test_entity_diff(spark):
    a = entities(spark, ("Product", "p", {"name": "a", "sku": "1", "gone": "x"}, [("Product", "eligible")]), ("Article", "x", {}, []), ("Article", "x", {"second": "ignored"}, []))
    b = entities(spark, ("Product", "p", {"name": "b", "sku": "1", "new": "y", "blank": " "}, [("Product", "ineligible")]), ("Event", None, {"n": "1"}, []))
    assert {(r.change_type, r.entity_type, r.severity) for r in history.entity_changes(a, b).collect()} == {("schema_modified", "Product", "medium"), ("schema_removed", "Article", "high"), ("schema_added", "Event", "info")}
    assert {(r.property, r.change_type, r.severity) for r in history.property_changes(a, b).collect()} == {("name", "property_value_changed", "low"), ("gone", "property_removed", "high"), ("new", "property_added", "info")}
    assert [(r.profile, r.severity) for r in history.rich_changes(a, b).collect()] == [("Product", "high")]
    assert history.entity_changes(a, a).count() == 0 and history.property_changes(a, a).count() == 0
    mirror = {"schema_added": "schema_removed", "schema_removed": "schema_added", "schema_modified": "schema_modified"}
    assert {(r.key, mirror[r.change_type]) for r in history.entity_changes(b, a).collect()} == {(r.key, r.change_type) for r in history.entity_changes(a, b).collect()}
    records = history.change_records(history.entity_changes(a, b).withColumn("property", F.lit(None).cast("string")).withColumn("before", F.lit(None).cast("string")))
    assert records.where("before is null").count() == 0


def test_values_are_compared_as_scalars(spark):
    row = lambda h, p: (1, 0, "Product", "i", h, p)
    frame = lambda h, p: spark.createDataFrame([row(h, p)], "page_id long, pos int, type string, identity string, entity_hash string, properties string")
    same = [
        ('{"a": 1, "b": [1.0, "x"], "c": true}', '{"c": true, "b": [1, "x"], "a": 1.0}'),
        ('{"o": {"type": "Offer", "identity": null, "properties": {"price": 1, "x": 2}}}', '{"o": {"properties": {"x": 3}, "identity": null, "type": "Offer"}}'),
        ('{"o": [{"type": "T", "identity": "i", "properties": {"a": "b"}}, {"ref": "#r"}]}', '{"o": [{"identity": "i", "type": "T", "properties": {}}, {"ref": "#r"}]}'),
        ('{"blank": " ", "none": [], "nil": null}', "{}"),
        ("not json", "{}"),
    ]
    for one, two in same:
        assert history.property_changes(frame("1", one), frame("2", two)).count() == 0, one
    was = '{"n": 1, "l": ["a", "b"], "o": {"type": "Offer", "identity": "x"}, "r": {"ref": "#a"}, "t": "s"}'
    now = '{"n": "1", "l": ["b", "a"], "o": {"type": "Offer", "identity": "y"}, "r": {"ref": "#b"}, "t": "s"}'
    got = {r.property: (r.change_type, r.before, r.after) for r in history.property_changes(frame("1", was), frame("2", now)).collect()}
    changed = "property_value_changed"
    assert got == {"n": (changed, "1", "1"), "l": (changed, '["a","b"]', '["b","a"]'), "o": (changed, '{"type":"Offer","identity":"x"}', '{"type":"Offer","identity":"y"}'), "r": (changed, '{"ref":"#a"}', '{"ref":"#b"}')}


def test_carry_children_and_issue_changes(spark):
    carried = spark.createDataFrame([(2, 1)], "crawl_id int, page_id int")
    kids = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "crawl_id int, page_id int, v string")
    assert [(r.crawl_id, r.v) for r in history.carry_children(carried, kids).collect()] == [(2, "x")]
    side = lambda *p: spark.createDataFrame([(x,) for x in p], "fingerprint string")
    assert {tuple(r) for r in history.issue_changes(side("a", "b"), side("b", "c")).collect()} == {("a", "resolved"), ("c", "introduced")}


def test_trend_by_month(spark):
    daily = spark.sql("select 1 as g, date'2024-01-01' as day, 1.0 as score union all select 1, date'2024-01-20', 2.0 union all select 1, date'2024-02-01', 3.0")
    assert sorted((str(r.period), float(r.score)) for r in history.trend_by(daily, "month", ["g"]).collect()) == [("2024-01-01", 2.0), ("2024-02-01", 3.0)]


def test_paging_walks_all_rows_once(spark):
    rows = spark.range(0, 25).select((F.col("id") / 4).cast("int").alias("t"), "id")
    seen, cursor = [], None
    while True:
        page = reports.keyset_page(rows, ["t", "id"], cursor, 10)
        seen += [r.id for r in page.orderBy("t", "id").collect()]
        cursor = reports.next_cursor(page, ["t", "id"])
        if cursor is None:
            break
    assert seen == list(range(25))


def test_plans_have_no_products(spark):
    pages = spark.range(5).select(F.col("id").alias("page_id"), F.array(F.struct(F.lit("u").alias("href"), F.lit("t").alias("text"), F.lit("s").alias("selector"), F.lit("h").alias("snippet"))).alias("links"))
    results = spark.range(5).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(True).alias("is_internal"), F.lit(False).alias("ok"), F.lit(404).alias("status"), F.lit("").alias("error"), F.lit(3).alias("redirect_hops"))
    for frame in (crosspage.broken_links(pages, results), crosspage.redirect_chains(pages, results)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = reports.keyset_desc(spark.range(100), "id", 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_orphans(spark):
    listed, edges = spark.createDataFrame([("a",), ("b",)], "url string"), spark.createDataFrame([("x", "a")], "source string, target string")
    assert [r.url for r in crosspage.orphans(listed, edges).collect()] == ["b"]


def test_empty_lists_and_coverage(spark):
    rows = spark.createDataFrame([(1, [("Product", "eligible")]), (1, []), (2, [("Product", "ineligible")])], "page_id int, rich array<struct<profile: string, status: string>>")
    assert tuple(reports.coverage(rows).first()) == (3, 2, 1)
    assert {tuple(r) for r in reports.rich_rollup(rows).collect()} == {("Product", "eligible", 1), ("Product", "ineligible", 1)}


def test_relations_between_pages(spark):
    kind = "url string, final_url string, http_status int, hreflang array<struct<lang: string, href: string>>, canonicals array<string>, robots struct<noindex: boolean, header_noindex: boolean>"
    pages = spark.createDataFrame(
        [
            ("a", "a", 200, [("en", "a"), ("de", "b"), ("fr", "c")], ["a"], (False, False)),
            ("b", "b", 200, [("en", "a")], ["gone"], (False, True)),
            ("c", "c", 200, [], ["c"], (True, False)),
            ("gone", "gone", 404, [], [], (False, False)),
        ],
        kind,
    )
    assert [tuple(r) for r in crosspage.hreflang_without_return(pages).collect()] == [("a", "c")]
    assert {r.url for r in crosspage.listed_but_noindex(pages.select("url"), pages).collect()} == {"b", "c"}
    assert [tuple(r) for r in crosspage.canonical_to_error(pages).collect()] == [("b", "gone", 404)]


def test_a_title_on_very_many_pages_gives_short_rows(spark):
    from sitelens.operators import crosspage

    pages = spark.range(60000).selectExpr("id AS page_id", "concat('u', lpad(CAST(id AS STRING), 6, '0')) AS url", "CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('t', id div 6) END AS title", "CASE WHEN id % 3 > 0 THEN 'h' ELSE concat('t', id div 6) END AS title_hash").repartition(8)
    members = crosspage.duplicate_members(pages, "title")
    assert members.count() == 60000
    heads = crosspage.group_heads(members, 4)
    assert [(r.page_count, r.urls) for r in heads.where("hash = 'h'").collect()] == [(40000, ["u000001", "u000002", "u000004", "u000005"])]
    assert heads.where("size(urls) > 4").count() == 0 and heads.count() == 10001
    near = {r.page_id: r.urls for r in crosspage.first_siblings(members, 4).where("page_id in (2, 59999, 0)").collect()}
    assert near == {0: ["u000003"], 2: ["u000001", "u000004", "u000005", "u000007"], 59999: ["u000001", "u000002", "u000004", "u000005"]}

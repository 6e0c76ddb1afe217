import json

import pytest
from pyspark.sql import functions as F
from sitelens import catalog
from sitelens.operators import artifacts, checks, crosspage, scoring, structured
from sitelens.sources import readers

GOOD = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>A fine title here</title>
<meta name="Description" content="A description that is long enough to be accepted by all the rules.">
<meta name="viewport" content="width=device-width, initial-scale=1"><link rel="canonical" href="/">
<link rel="icon" href="/i.png"><meta property="og:title" content="t"><meta property="og:type" content="t"><meta property="og:image" content="t">
<meta property="og:url" content="t"><meta name="twitter:card" content="summary">{head}</head>
<body><h1>Heading</h1><p>Some words</p>{body}</body></html>"""


def page(spark, head="", body="", html=None, url="https://www.example.com/", **more):
    row = {"page_id": 1, "url": url, "html": GOOD.replace("{head}", head).replace("{body}", body) if html is None else html} | more
    kinds = {"page_id": "long", "html": "string", "url": "string", "final_url": "string", "http_status": "int", "headers": "map<string,string>", "error": "string"}
    return readers.as_pages(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row)))


def found(spark, **kw):
    return sorted(r.check_id for r in checks.run(artifacts.extract(page(spark, **kw))).collect())


def test_clean_page_has_no_findings(spark):
    assert found(spark) == []


CASES = [
    (dict(html="<p>x</p>"), ["headings.h1.missing", "meta.canonical.missing", "meta.charset.missing", "meta.description.missing", "meta.lang.missing", "meta.title.missing", "meta.viewport.missing", "social.og.missing_required", "social.twitter.missing_card"]),
    (dict(head='<link rel="canonical" href="http://other.org/">'), ["meta.canonical.cross_domain", "meta.canonical.multiple", "meta.canonical.non_https"]),
    (dict(head='<meta name="robots" content="index, noindex">'), ["meta.robots.conflicting", "meta.robots.noindex"]),
    (dict(head='<meta name="robots" content="none">'), ["meta.robots.nofollow", "meta.robots.noindex"]),
    (dict(headers={"X-Robots-Tag": "noindex"}, url="https://www.example.com/x"), ["meta.robots.noindex", "technical.indexability.conflict"]),
    (dict(body="<h1>Two</h1>"), ["headings.h1.multiple"]),
    (dict(body="<h4> </h4>"), ["headings.any.empty", "headings.hierarchy.skipped_level"]),
    (dict(body='<img src="a.png">'), ["images.alt.missing", "images.dimensions.missing_height", "images.dimensions.missing_width"]),
    (dict(body='<img src="a.png" alt=" " width=1 height=1>'), ["images.alt.empty_on_meaningful"]),
    (dict(body='<img src="http://x.org/a.png" alt="x" width=1 height=1>'), ["technical.https.mixed_content"]),
    (dict(body='<a href="/x">Read More</a><a href="/y" target="_blank">Fine text</a>'), ["links.anchor.empty_or_generic", "links.rel.noopener_missing_on_blank"]),
    (dict(body='<a href="mailto:x">here</a><a href="/y" target="_blank" rel="noopener">Fine text</a>'), []),
    (dict(http_status=404), ["technical.status.4xx"]),
    (dict(http_status=503), ["technical.status.5xx"]),
    (dict(final_url="https://www.example.com/new"), ["technical.redirect.present"]),
    (dict(url="http://www.example.com/"), ["meta.canonical.non_https", "technical.https.not_secure"]),
]


@pytest.mark.parametrize("kw,want", CASES)
def test_checks(spark, kw, want):
    assert found(spark, **kw) == want


def test_artifact_fields(spark):
    body = '<div id="m"><h2>Deep</h2><img data-src="/l.png" alt=""></div><ul><li><a href="//blog.example.com/é#f" rel="NoFollow x">Go</a><li><a href="https://e.org">E</a></ul><script>var x = "<h3>no</h3>"</script>'
    row = artifacts.extract(page(spark, body=body, headers={"ETag": "e1", "Content-Type": "text/html"})).first()
    assert row.canonicals == ["https://www.example.com/"] and row.favicon and row.og_tags["og:title"] == "t"
    assert [(h.level, h.text, h.selector) for h in row.headings] == [(1, "Heading", "body > h1"), (2, "Deep", "#m > h2")]
    assert (row.images[0].src, row.images[0].lazy, row.images[0].width) == ("https://www.example.com/l.png", True, None)
    assert [(x.href, x.internal, x.nofollow) for x in row.links] == [("https://blog.example.com/%C3%A9", True, True), ("https://e.org/", False, False)]
    assert row.links[1].selector.endswith("ul > li:nth-of-type(2) > a") and row.links[1].snippet == '<a href="https://e.org">E</a>'
    assert (row.etag, row.content_type, row.html_lang, row.h1_text) == ("e1", "text/html", "en", "Heading")
    assert row.word_count == 2  # elements' texts are joined as they stand: "HeadingSome", "wordsDeepGoE"
    assert artifacts.extract(page(spark, html=None).withColumn("html", F.lit(None).cast("string"))).first().title is None


def test_registry_of_checks(spark):
    with pytest.raises(ValueError):
        checks.register("meta.title.missing", lambda: F.array())
    checks.register("custom.words.few", lambda: checks._one(F.col("word_count") < 100, "Few words."), severity="low", weight=2)
    try:
        assert found(spark) == ["custom.words.few"]
        assert checks.run(artifacts.extract(page(spark)), disabled=["custom.words.few"]).count() == 0
    finally:
        checks.unregister("custom.words.few")
    assert catalog.as_df(spark).count() == 47 and len(catalog.PAGE_CHECKS) == 42


def test_link_results(spark):
    pages = artifacts.extract(page(spark, body='<a href="/b">Bad one</a><a href="https://e.org/b">Bad two</a><a href="/b">Bad again</a><img src="/i.png" alt=x width=1 height=1>'))
    results = spark.createDataFrame([("https://www.example.com/b", True, False, 404, None, 3), ("https://e.org/b", False, False, None, "timeout", 0), ("https://www.example.com/i.png", True, False, 500, None, 0)], "url string, is_internal boolean, ok boolean, status int, error string, redirect_hops int")
    ids = sorted(r.check_id for r in checks.run(pages, results).collect())
    assert ids == ["images.src.broken", "links.external.broken", "links.internal.broken", "links.internal.broken", "links.redirect.chain_too_long", "links.redirect.chain_too_long"]
    assert sorted((r.check_id, r.anchor) for r in crosspage.broken_links(pages, results).collect()) == [("links.external.broken", "Bad two"), ("links.internal.broken", "Bad one")]
    assert crosspage.broken_images(pages, results).count() == 1 and crosspage.redirect_chains(pages, results).count() == 1


def test_scores(spark):
    def score(*rows):
        frame = spark.createDataFrame([(1, *r) for r in rows], "page_id int, check_id string, severity string, status string")
        return scoring.page_scores(frame).first().score

    title = ("meta.title.missing", "critical", "fail")
    assert score(title) == 75 and score(("meta.description.missing", "high", "fail")) == 91
    assert score(*[("images.alt.missing", "high", "fail")] * 4) == 100 - 12 * 1.2 * 0.6
    assert score(("meta.title.missing", "critical", "pass"), title) == 75 and score(("no.such", "critical", "fail")) == 100
    assert score(*[(c[0], "critical", "fail") for c in catalog.PAGE_CHECKS]) == 0
    snaps = lambda *r: spark.createDataFrame(r, "score double, issue_counts map<string,int>")
    assert scoring.site_score(snaps((90.0, {"critical": 1}), *[(90.0, {})] * 9)).first().site_score == 90
    assert scoring.site_score(snaps((90.0, {"critical": 1}), *[(90.0, {})] * 8)).first().site_score == 79
    assert scoring.site_score(snaps((90.0, {})).limit(0)).first().site_score == 100


def vocabulary():
    types = {"Thing": [], "CreativeWork": ["Thing"], "Article": ["CreativeWork"], "Person": ["Thing"], "Organization": ["Thing"], "Place": ["Thing"], "LocalBusiness": ["Organization", "Place"], "Offer": ["Thing"], "Product": ["Thing"]}
    props = {("Thing", "name"): ["Text"], ("Thing", "url"): ["URL"], ("Thing", "image"): ["URL"], ("CreativeWork", "author"): ["Person", "Organization"], ("CreativeWork", "headline"): ["Text"], ("CreativeWork", "datePublished"): ["Date"], ("Product", "offers"): ["Offer"], ("Offer", "price"): ["Number"], ("Offer", "availability"): ["ItemAvailability"], ("Place", "address"): ["Text"], ("Organization", "logo"): ["URL"]}
    return structured.Vocabulary(types, props)


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks)


def test_structured_extraction(spark):
    body = ld({"@graph": [{"@type": "Article", "headline": "H", "author": {"@type": "Person", "name": "A"}}, {"@type": ["https://schema.org/Product"], "@id": "#p", "name": [{"@value": "N"}], "brand": {"@id": "#b"}}]}, '{"@type": "Thing", "name": "x",}', "{bad")
    body += '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">M</span><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="3"></div><a itemprop="url" href="/u">x</a></div>'
    body += '<div typeof="schema:Person" resource="#r"><span property="name">R</span><img property="image" src="/i"></div>'
    out = structured.extract(page(spark, body=body).select("page_id", "html"))
    rows = {(r.format, r.type): r for r in structured.entities(out).collect()}
    assert set(rows) == {("json-ld", "Article"), ("json-ld", "Product"), ("json-ld", "Thing"), ("microdata", "Product"), ("rdfa", "Person")}
    assert json.loads(rows["json-ld", "Product"].properties) == {"name": "N", "brand": {"ref": "#b"}} and rows["json-ld", "Product"].identity == "#p"
    assert json.loads(rows["microdata", "Product"].properties)["offers"]["properties"] == {"price": "3"} and rows["microdata", "Product"].identity == "/u"
    assert json.loads(rows["rdfa", "Person"].properties) == {"name": "R", "image": "/i"} and rows["rdfa", "Person"].id == "#r"
    assert structured.parse_errors(out).count() == 1
    one, two = ({"@type": "Thing", "name": "a", "url": "u"}, {"url": "u", "name": "a", "@type": "Thing"})
    hashes = {r.entity_hash for r in structured.extract(page(spark, body=ld(one, two)).select("page_id", "html")).collect()}
    assert len(hashes) == 1


def test_structured_validation(spark):
    blocks = [
        {"@type": "Article", "headline": "H", "author": {"@type": "Person", "name": "A", "shoe": 1}, "datePublished": "yesterday", "reviews": "r"},
        {"@type": "Product", "name": "N", "image": "https://e.com/i", "offers": {"@type": "Offer", "price": "x", "availability": "https://schema.org/InStock"}},
        {"@type": "Nonsense", "name": "x"},
        {"name": "only"},
        {"@type": "LocalBusiness", "name": "L", "address": "A", "logo": "https://e.com/l"},
    ]
    out = structured.extract(page(spark, body=ld(*blocks)).select("page_id", "html"))
    results = structured.validate(out, vocabulary())
    got = {(r.pos, r.check_id) for r in results.where("check_id not like '%recommended%'").collect()}
    assert got == {(0, "schema.article.type.datePublished"), (0, "schema.article.deprecated.reviews"), (0, "schema.article.invalid_property.reviews"), (0, "schema.person.invalid_property.shoe"), (1, "schema.offer.type.price"), (2, "schema.unknown_type"), (3, "schema.untyped")}
    statuses = structured.status(out, results)
    assert {r.pos: r.status for r in statuses.collect()} == {0: "errors", 1: "errors", 2: "warnings", 3: "warnings", 4: "warnings"}
    assert {r.pos: r.confidence for r in structured.confidence(out, vocabulary()).collect()} == {0: 1.0, 1: 1.0, 2: 0.8, 3: 0.8, 4: 1.0}
    verdicts = {(r.pos, r.profile): r.status for r in structured.rich_results(out).collect()}
    assert verdicts == {(0, "Article"): "eligible_with_warnings", (1, "Product"): "eligible_with_warnings", (4, "Organization"): "eligible_with_warnings", (4, "LocalBusiness"): "eligible_with_warnings"}
    bare = structured.extract(page(spark, body=ld({"@type": "Product", "name": " "})).select("page_id", "html"))
    verdict = structured.rich_results(bare).first()
    assert verdict.status == "ineligible" and verdict.missing_required == ["image", "name"]
    assert structured.rich_results(out, disabled=["Product"]).where("profile = 'Product'").count() == 0
    cover = structured.page_coverage(out, statuses, structured.rich_results(out)).first()
    assert (cover.entity_count, cover.error_count, cover.warning_count, cover.rich_eligible_count) == (5, 2, 3, 3) and cover.type_counts["Unknown"] == 1
    assert structured.to_rows(out, statuses, structured.confidence(out, vocabulary())).count() == 5
    assert vocabulary().closure_df(spark).where("type = 'LocalBusiness'").count() == 4


def test_one_bad_page_among_good_ones(spark):
    bad = ['{"@type":"Product","name":"a\\ud800b"}', '{"@type":"Product","a":NaN}', '{"@type":"Product","a":-Infinity}', '{"@type":"Product","a":1e999}', '{"@type":"Product","\\uDC00k":"\\ud83d\\ude00"}', '{"@type":"Product","name":"good"}']
    pages = spark.createDataFrame([(i, ld(b)) for i, b in enumerate(bad)], "page_id long, html string")
    out = structured.extract(pages)
    found = {r.page_id: json.loads(r.properties) for r in structured.entities(out).collect()}
    assert found == {0: {"name": "a\ufffdb"}, 4: {"\ufffdk": "\U0001f600"}, 5: {"name": "good"}}
    assert {r.page_id for r in structured.parse_errors(out).collect()} == {1, 2, 3}


def test_what_an_unknown_property_holds_is_not_judged(spark):
    inner = {"@type": "Nonsense", "shoe": {"@type": "Offer", "price": "x"}}
    out = structured.extract(page(spark, body=ld({"@type": "Thing", "name": "n", "odd": [inner], "oddly": 1, "subjectOf": {"@type": "Offer", "price": "y"}})).select("page_id", "html"))
    got = {(r.check_id, r.entity_type) for r in structured.validate(out, vocabulary()).collect()}
    assert got == {("schema.thing.invalid_property.odd", "Thing"), ("schema.thing.invalid_property.oddly", "Thing"), ("schema.offer.type.price", "Offer")}
    assert structured.confidence(out, vocabulary()).first().confidence == 1.0


def test_the_nearest_definition_counts(spark):
    # D names B before C: what B inherits from A is nearer than what C defines; circles end
    types = {"A": [], "B": ["A"], "C": ["A"], "D": ["B", "C"], "X": ["Y"], "Y": ["X", "Lost"]}
    v = structured.Vocabulary(types, {("A", "p"): ["Text"], ("C", "p"): ["URL"], ("C", "q"): ["URL"], ("D", "r"): ["Date"], ("Y", "s"): ["Text"], ("Lost", "t"): ["Text"]})
    allowed = {(r.known, r.property): r.expected for r in v.allowed_df(spark).collect()}
    assert {k[1]: e for k, e in allowed.items() if k[0] == "D"} == {"p": ["Text"], "q": ["URL"], "r": ["Date"]}
    assert allowed["X", "s"] == ["Text"] and allowed["X", "t"] == ["Text"] and allowed["C", "p"] == ["URL"]
    assert {(r.type, r.ancestor) for r in v.closure_df(spark).where("type in ('X', 'Y')").collect()} == {(a, b) for a in "XY" for b in ("X", "Y", "Lost")}


def test_vocabulary_of_a_release(spark, tmp_path):
    graph = [
        {"@id": "schema:Thing", "@type": "rdfs:Class"},
        {"@id": "schema:Text", "@type": ["schema:DataType", "rdfs:Class"]},
        {"@id": "schema:Product", "@type": "rdfs:Class", "rdfs:subClassOf": {"@id": "schema:Thing"}},
        {"@id": "schema:Car", "@type": "rdfs:Class", "rdfs:subClassOf": [{"@id": "schema:Vehicle"}, {"@id": "https://schema.org/Product"}]},
        {"@id": "schema:Shade", "@type": "rdfs:Class", "rdfs:subClassOf": {"@id": "schema:Enumeration"}},
        {"@id": "schema:Dark", "@type": "schema:Shade"},
        {"@id": "schema:shade", "@type": "rdf:Property", "schema:domainIncludes": {"@id": "schema:Product"}, "schema:rangeIncludes": [{"@id": "schema:Shade"}]},
        {"@id": "schema:tone", "@type": "rdf:Property", "schema:domainIncludes": {"@id": "schema:Product"}, "schema:rangeIncludes": {"@id": "schema:Text"}, "schema:supersededBy": {"@id": "schema:shade"}},
    ]
    path = tmp_path / "release.jsonld"
    path.write_text(json.dumps({"@context": {}, "@graph": graph}, indent=1))
    v = structured.Vocabulary.from_release(spark, str(path))
    assert {(r.known, r.property, *r.expected) for r in v.allowed_df(spark).collect()} == {(t, p, e) for t in ("Car", "Product") for p, e in (("shade", "Shade"), ("tone", "Text"))}
    blocks = [{"@type": "Car", "shade": "http://schema.org/Dark", "tone": "t"}, {"@type": "Product", "shade": "Light"}]
    out = structured.extract(page(spark, body=ld(*blocks)).select("page_id", "html"))
    got = {(r.pos, r.check_id) for r in structured.validate(out, v).where("check_id not like '%re%d.%' or check_id like '%deprecated%'").collect()}
    assert got == {(0, "schema.car.deprecated.tone"), (1, "schema.product.type.shade")}


def test_page_level_structured_checks(spark):
    site = {"@type": "WebSite", "name": "a"}
    out = structured.extract(page(spark, body=ld(site, site, {"@type": "WebSite", "name": "b"})).select("page_id", "html"))
    assert {(r.check_id, r.n) for r in structured.page_checks(out).collect()} == {("schema.page.duplicate", 2), ("schema.page.conflicting", 3)}


def test_value_forms(spark):
    cases = [("2024-02-30", "Date", False), ("2024-02-28T10:00Z", "Date", True), ("x", "URL", False), ("https://e.com", "URL", True), ("1.5", "Number", True), ("1.5", "Integer", False), ("True", "Boolean", True), ("InStock", "ItemAvailability", True), ("Gone", "ItemAvailability", False), ("x", "Text", True)]
    for text, kind, want in cases:
        assert spark.range(1).select(structured.value_matches(F.lit(text), kind)).first()[0] is want, (text, kind)


def test_hostile_pages_end(spark):
    deep = ["[" * 50000, "[" * 900 + "]" * 900, '{"a":' * 900 + "1" + "}" * 900]
    body = "".join(f'<script type="application/ld+json">{d}</script>' for d in deep) + "<div itemscope itemprop=p>" * 1500 + "<div typeof=T property=p>" * 1500
    out = structured.extract(page(spark, body=body).select("page_id", "html"))
    assert structured.parse_errors(out).where("error like '%deeper%'").count() >= 3
    for body in ("<a href=/x>" * 8000, "<a " * 40000, "<p><table>" + "<div>" * 20000 + "</p>" * 20000, "<script>" + "</script " * 40000):
        assert artifacts.extract(page(spark, body=body)).select("word_count").first().word_count >= 2


def test_lists_and_empty_values(spark):
    body = ld({"@type": "Thing", "name": ["a", None, ["b"]], "url": [], "image": [{"@value": 1.0}], "subjectOf": {}})
    row = structured.extract(page(spark, body=body).select("page_id", "html")).first()
    assert json.loads(row.properties) == {"name": ["a", "b"], "url": [], "image": 1.0} and row.identity == "a"


def test_links_by_a_table_function(spark):
    from sitelens.operators import tables

    body = '<p><a href="/x" rel="NoFollow me"> Go <b>there</b>\xa0</a><a>none</a><a href="mailto:x">m</a><a href="https://else.org/y"></a><a href="sub?b=2&a=1#f">s</a></p>'
    tables.register_all(spark)
    frame = page(spark, body=body)
    got = spark.sql("SELECT l.* FROM {p} p, LATERAL extract_links(p.html, p.final_url) l", p=frame).collect()
    want = artifacts.extract(frame).first().links
    assert [(r.href, r.text, r.rel, r.internal, r.nofollow) for r in got] == [(x.href, x.text, x.rel, x.internal, x.nofollow) for x in want] and len(got) == 3
    assert spark.sql("SELECT * FROM extract_links(CAST(NULL AS STRING), 'https://e.com')").collect() == []

"""Queries of what the given pages lack: markup made from the parts, so that each field and check has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import urls
from ..operators import artifacts, checks, crosspage, history, reports, scoring, structured, tables
from ..sources import readers, store
from ..streaming import progress
from . import frames as f
from .more import _ENTITIES, _STATUS, _VERDICT, VOCABULARY, _marked_once, _scored
from .registry import register

SITE = "https://shop.example.com"
#: Pieces of a page; k is the number of the part.
PARTS = {
    "title": "CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN '<title> </title>' WHEN 2 THEN concat('<title>', repeat('t', 61), '</title>') WHEN 3 THEN '<title>Short</title>' ELSE concat('<title>Product page ', CAST(k AS STRING), '</title>') END",
    "description": "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN concat('<meta name=\"Description\" content=\"', repeat('d', 161), '\">') WHEN 2 THEN '<meta name=\"description\" content=\" short text \">' ELSE concat('<meta name=\"description\" content=\"', repeat('d', 90), CAST(k % 40 AS STRING), '\">') END",
    "canonical": "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN concat('<link rel=\"canonical\" href=\"/p/', CAST(k AS STRING), '\"><link rel=\"canonical\" href=\"/other\">') WHEN 2 THEN concat('<link rel=\"canonical\" href=\"http://shop.example.com/p/', CAST(k AS STRING), '\">') WHEN 3 THEN '<link rel=\"canonical\" href=\"https://else.org/p\">' ELSE concat('<link rel=\"canonical\" href=\"/p/', CAST(k AS STRING), '\">') END",
    "robots": "CASE k % 8 WHEN 0 THEN '<meta name=\"robots\" content=\"NOINDEX\">' WHEN 1 THEN '<meta name=\"robots\" content=\"nofollow\">' WHEN 2 THEN '<meta name=\"robots\" content=\"index, noindex\">' ELSE '' END",
    "charset": "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '<meta http-equiv=\"Content-Type\" content=\"text/html; charset=Latin1\">' ELSE '<meta charset=\"UTF-8\">' END",
    "viewport": "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '<meta name=\"viewport\" content=\"width=1024\">' WHEN 2 THEN '<meta name=\"viewport\" content=\"width=device-width, user-scalable=no\">' ELSE '<meta name=\"viewport\" content=\"width=device-width\">' END",
    "links": "CASE WHEN k % 3 = 0 THEN concat('<link rel=\"alternate\" hreflang=\"de\" href=\"/de/', CAST(k AS STRING), '\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"mailto:x\">') ELSE '' END",
    "icon": "CASE WHEN k % 2 = 0 THEN '<link rel=\"shortcut icon\" href=\"/i.ico\">' ELSE '' END",
    "og": "CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '<meta property=\"og:title\" content=\"one\"><meta property=\"og:title\" content=\"two\">' ELSE '<meta property=\"og:title\" content=\"t\"><meta property=\"og:type\" content=\"t\"><meta name=\"OG:image\" content=\"t\"><meta property=\"og:url\" content=\"t\">' END",
    "card": "CASE WHEN k % 2 = 1 THEN '<meta name=\"twitter:card\" content=\"summary\">' ELSE '' END",
    "h1": "CASE k % 11 WHEN 0 THEN '' WHEN 1 THEN '<h1>First one</h1><h1>Second one</h1>' WHEN 2 THEN concat('<h1>PRODUCT page ', CAST(k AS STRING), '</h1>') WHEN 3 THEN '<h1> </h1>' ELSE concat('<h1>Heading ', CAST(k AS STRING), '</h1>') END",
    "h3": "CASE WHEN k % 4 = 1 THEN '<div id=\"low\"><h3>Lower <b>still</b></h3></div>' ELSE '' END",
    "image": "CASE k % 3 WHEN 0 THEN concat('<img src=\"/i/', CAST(k AS STRING), '.png\">') WHEN 1 THEN concat('<img data-src=\"/l/', CAST(k AS STRING), '.png\" alt=\" \" width=\"10\" height=\"10\" loading=\"lazy\">') ELSE '<img src=\"http://cdn.example.org/c.png\" alt=\"p\" width=\"1\" height=\"1\">' END",
    "open": "CASE WHEN k % 2 = 0 THEN concat('<a href=\"/x/', CAST(k AS STRING), '\" target=\"_blank\">Open   x</a>') ELSE '' END",
    "here": "CASE WHEN k % 5 = 0 THEN '<a href=\"https://else.org/y\" rel=\"nofollow\">Here</a>' ELSE '' END",
}
LANG = "CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN ' lang=\"e1_x\"' ELSE ' lang=\"en-GB\"' END"
_HEAD, _BODY = list(PARTS)[:10], list(PARTS)[10:]
HTML = f"concat('<!doctype html><html', {LANG}, '><head>', {', '.join(PARTS[p] for p in _HEAD)}, '</head><body>', {', '.join(PARTS[p] for p in _BODY)}, '<script>var x = 1</script></body></html>')"
HEADERS = "map('ETag', concat('e', CAST(k AS STRING)), 'Last-Modified', 'Mon', 'CONTENT-TYPE', 'text/html', 'X-Robots-Tag', CASE WHEN k % 16 = 3 THEN 'noarchive, noindex' ELSE 'all' END)"
#: Fields of these pages as SQL states them, without reading any HTML.
FIELDS_SQL = f"""(SELECT k, '{SITE}/p/' || k AS url,
  CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN repeat('t', 61) WHEN 3 THEN 'Short' ELSE 'Product page ' || k END AS title,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN repeat('d', 161) WHEN 2 THEN 'short text' ELSE repeat('d', 90) || (k % 40) END AS description,
  CASE k % 6 WHEN 0 THEN [] WHEN 1 THEN ['{SITE}/p/' || k, '{SITE}/other'] WHEN 2 THEN ['http://shop.example.com/p/' || k] WHEN 3 THEN ['https://else.org/p'] ELSE ['{SITE}/p/' || k] END AS canonicals,
  CASE k % 8 WHEN 0 THEN 'NOINDEX' WHEN 1 THEN 'nofollow' WHEN 2 THEN 'index, noindex' END AS robots, k % 16 = 3 AS sent_noindex,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'latin1' ELSE 'utf-8' END AS charset,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'width=1024' WHEN 2 THEN 'width=device-width, user-scalable=no' ELSE 'width=device-width' END AS viewport,
  CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN 'e1_x' ELSE 'en-GB' END AS lang,
  CASE k % 11 WHEN 0 THEN [] WHEN 1 THEN ['First one', 'Second one'] WHEN 2 THEN ['PRODUCT page ' || k] WHEN 3 THEN [''] ELSE ['Heading ' || k] END AS h1,
  CASE k % 3 WHEN 0 THEN '{SITE}/i/' || k || '.png' WHEN 1 THEN '{SITE}/l/' || k || '.png' ELSE 'http://cdn.example.org/c.png' END AS image
  FROM (SELECT p_partkey AS k FROM part))"""
_CASES = [
    ("meta.title.missing", "title IS NULL"),
    ("meta.title.empty", "title = ''"),
    ("meta.title.too_long", "length(title) > 60"),
    ("meta.title.too_short", "length(title) BETWEEN 1 AND 9"),
    ("meta.description.missing", "description IS NULL"),
    ("meta.description.too_long", "length(description) > 160"),
    ("meta.description.too_short", "length(description) < 50"),
    ("meta.canonical.missing", "len(canonicals) = 0"),
    ("meta.canonical.multiple", "len(canonicals) > 1"),
    ("meta.canonical.non_https", "k % 6 = 2"),
    ("meta.canonical.cross_domain", "k % 6 = 3"),
    ("meta.robots.noindex", "k % 8 IN (0, 2) OR sent_noindex"),
    ("meta.robots.nofollow", "k % 8 = 1"),
    ("meta.robots.conflicting", "k % 8 = 2"),
    ("meta.charset.missing", "charset IS NULL"),
    ("meta.viewport.missing", "viewport IS NULL"),
    ("meta.viewport.not_responsive", "k % 4 IN (1, 2)"),
    ("meta.lang.missing", "lang IS NULL"),
    ("meta.lang.invalid_bcp47", "lang = 'e1_x'"),
    ("headings.h1.missing", "len(h1) = 0"),
    ("headings.h1.multiple", "len(h1) > 1"),
    ("headings.h1.duplicate_of_title", "title <> '' AND lower(h1[1]) = lower(title)"),
    ("headings.hierarchy.skipped_level", "k % 4 = 1 AND len(h1) > 0"),
    ("headings.any.empty", "h1[1] = ''"),
    ("images.alt.missing", "k % 3 = 0"),
    ("images.alt.empty_on_meaningful", "k % 3 = 1"),
    ("images.dimensions.missing_width", "k % 3 = 0"),
    ("images.dimensions.missing_height", "k % 3 = 0"),
    ("images.src.broken", "length(image) % 7 = 0"),
    ("links.internal.broken", f"k % 2 = 0 AND length('{SITE}/x/' || k) % 7 = 0"),
    ("links.external.broken", "k % 5 = 0"),
    ("links.redirect.chain_too_long", f"k % 2 = 0 AND length('{SITE}/x/' || k) % 4 = 3"),
    ("links.rel.noopener_missing_on_blank", "k % 2 = 0"),
    ("links.anchor.empty_or_generic", "k % 5 = 0"),
    ("technical.https.mixed_content", "k % 3 = 2"),
    ("technical.indexability.conflict", "(k % 8 IN (0, 2) OR sent_noindex) AND k % 6 IN (1, 2, 3)"),
    ("social.og.missing_required", "k % 3 < 2"),
    ("social.twitter.missing_card", "k % 2 = 0"),
]


def pages(spark, d) -> DataFrame:
    rows = f.table(spark, d, "part").selectExpr("p_partkey AS k")
    made = rows.selectExpr("k AS page_id", f"concat('{SITE}/p/', CAST(k AS STRING)) AS url", f"{HTML} AS html", f"{HEADERS} AS headers")
    return readers.as_pages(made)


def extracted(spark, d) -> DataFrame:
    return artifacts.extract(pages(spark, d))


def link_results(found: DataFrame) -> DataFrame:
    """What the targets of these pages answer: by the length of the address, but one foreign page that is never there."""
    urls = found.select(F.explode("links.href").alias("url"), F.lit(True).alias("link")).unionByName(found.select(F.explode("images.src").alias("url"), F.lit(False).alias("link"))).groupBy("url").agg(F.max("link").alias("link"))
    inner = F.col("url").startswith(SITE)
    gone = (F.length("url") % 7 == 0) | (F.col("url") == "https://else.org/y")
    hops = F.when(F.col("link") & inner, F.length("url") % 4).otherwise(0).cast("int")
    return urls.select("url", inner.alias("is_internal"), (~gone).alias("ok"), F.when(gone, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("error"), hops.alias("redirect_hops"))


@register("ext_2_6_head", "SELECT k AS page_id, description AS meta_description, viewport, charset, robots AS robots_raw, coalesce(k % 8 IN (0, 2), false) AS noindex, k % 8 = 1 AS nofollow, sent_noindex AS header_noindex, array_to_string(canonicals, '|') AS canonicals, k % 2 = 0 AS favicon, CASE WHEN k % 3 = 0 THEN 'de=" + SITE + "/de/' || k || '|x-default=mailto:x' ELSE '' END AS hreflang FROM " + FIELDS_SQL)
def _(spark, d):
    r = F.col("robots")
    langs = F.array_join(F.transform("hreflang", lambda h: F.concat(h["lang"], F.lit("="), h["href"])), "|")
    return extracted(spark, d).select("page_id", "meta_description", "viewport", "charset", r["raw"].alias("robots_raw"), r["noindex"].alias("noindex"), r["nofollow"].alias("nofollow"), r["header_noindex"].alias("header_noindex"), F.array_join("canonicals", "|").alias("canonicals"), "favicon", langs.alias("hreflang"))


@register("ext_8_images", "SELECT k AS page_id, image AS src, CASE k % 3 WHEN 1 THEN ' ' WHEN 2 THEN 'p' END AS alt, CASE k % 3 WHEN 1 THEN '10' WHEN 2 THEN '1' END AS width, CASE WHEN k % 3 = 1 THEN 'lazy' END AS loading, k % 3 = 1 AS lazy, 'body > img' AS selector FROM " + FIELDS_SQL)
def _(spark, d):
    return extracted(spark, d).select("page_id", F.explode("images").alias("i")).select("page_id", "i.src", "i.alt", "i.width", "i.loading", "i.lazy", "i.selector")


@register("ext_11_social", "SELECT k AS page_id, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'og:title=one' ELSE 'og:image=t|og:title=t|og:type=t|og:url=t' END AS og, CASE WHEN k % 2 = 1 THEN 'twitter:card=summary' ELSE '' END AS twitter FROM " + FIELDS_SQL)
def _(spark, d):
    told = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return extracted(spark, d).select("page_id", told("og_tags").alias("og"), told("twitter_tags").alias("twitter"))


@register("ext_13_15_loads_and_headers", "SELECT k AS page_id, CASE WHEN k % 3 = 2 THEN 'http://cdn.example.org/c.png' ELSE '' END AS mixed, 'e' || k AS etag, 'Mon' AS last_modified, 'text/html' AS content_type, CASE WHEN description IS NOT NULL THEN md5(description) END AS description_hash FROM " + FIELDS_SQL)
def _(spark, d):
    return extracted(spark, d).select("page_id", F.array_join("mixed_content_urls", "|").alias("mixed"), "etag", "last_modified", "content_type", "description_hash")


@register(
    "ext_17_18_places",
    f"SELECT k AS page_id, 'h3' AS kind, 'Lower still' AS text, '#low > h3' AS selector, '<h3>Lower <b>still</b></h3>' AS snippet FROM {FIELDS_SQL} WHERE k % 4 = 1"
    f" UNION ALL SELECT k, 'h1', h1[n], CASE WHEN len(h1) > 1 THEN 'body > h1:nth-of-type(' || n || ')' ELSE 'body > h1' END, '<h1>' || CASE h1[n] WHEN '' THEN ' ' ELSE h1[n] END || '</h1>' FROM (SELECT *, unnest(range(1, len(h1) + 1)) AS n FROM {FIELDS_SQL})"
    f" UNION ALL SELECT k, 'a', 'Open   x', CASE WHEN k % 5 = 0 THEN 'body > a:nth-of-type(1)' ELSE 'body > a' END, '<a href=\"/x/' || k || '\" target=\"_blank\">Open x</a>' FROM {FIELDS_SQL} WHERE k % 2 = 0"
    f" UNION ALL SELECT k, 'a', 'Here', CASE WHEN k % 2 = 0 THEN 'body > a:nth-of-type(2)' ELSE 'body > a' END, '<a href=\"https://else.org/y\" rel=\"nofollow\">Here</a>' FROM {FIELDS_SQL} WHERE k % 5 = 0",
)
def _(spark, d):
    of = lambda kind: lambda x: F.struct(kind(x).alias("kind"), x["text"].alias("text"), x["selector"].alias("selector"), x["snippet"].alias("snippet"))
    heads = F.transform("headings", of(lambda x: F.concat(F.lit("h"), x["level"].cast("string"))))
    both = F.concat(heads, F.transform("links", of(lambda x: F.lit("a"))))  # one list, so that a page is read once
    return extracted(spark, d).select("page_id", F.explode(both).alias("x")).select("page_id", "x.*")


@register("chk_all_page_checks", "SELECT page_id, check_id, severity FROM (" + " UNION ALL ".join(f"SELECT k AS page_id, '{c}' AS check_id FROM {FIELDS_SQL} WHERE {w}" for c, w in _CASES) + ") JOIN (SELECT check_id, default_severity AS severity FROM " + f.CHECKS_SQL + ") USING (check_id)")
def _(spark, d):
    found = store.kept(extracted(spark, d), "pages")
    return checks.run(found, link_results(found)).select("page_id", "check_id", "severity")


@register("chk_43_fetch_failed", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'technical.fetch.failed' ELSE 'technical.status.error' END AS check_id, CASE WHEN p_partkey % 4 = 0 THEN 'timeout' WHEN p_partkey % 4 = 1 THEN NULL ELSE 'HTTP 503' END AS message FROM part WHERE p_partkey % 4 < 3")
def _(spark, d):
    k = F.col("page_id") % 4
    rows = pages(spark, d).withColumns({"error": F.when(k == 0, "timeout"), "html": F.when(k.isin(2, 3), F.col("html")), "http_status": F.when(k == 2, 503).when(k == 3, 200)})
    return checks.fetch_issues(rows).select("page_id", "check_id", "message")


@register("chk_45_duplicate_descriptions", f"SELECT k AS page_id, n AS duplicate_count FROM (SELECT k, description, count(*) OVER (PARTITION BY description) AS n FROM {FIELDS_SQL}) WHERE description IS NOT NULL AND n > 1")
def _(spark, d):
    return crosspage.duplicate_issues(extracted(spark, d), "description").select("page_id", "duplicate_count")


@register("chk_46_overrides_that_occur", f"SELECT k AS page_id, 'meta.title.too_long' AS check_id, 'high' AS severity FROM {FIELDS_SQL} WHERE length(title) > 60")
def _(spark, d):
    others = [c[0] for c in catalog.PAGE_CHECKS if c[0] != "meta.title.too_long"]
    return checks.run(extracted(spark, d), disabled=others, severity={"meta.title.too_long": "high"}).select("page_id", "check_id", "severity")


@register("udf_1_own_check", f"SELECT k AS page_id, 'custom.image.lazy' AS check_id, 'low' AS severity, '{catalog.VERSION}' AS rule_version FROM {FIELDS_SQL} WHERE k % 3 = 1")
def _(spark, d):
    own = "custom.image.lazy"
    checks.register(own, lambda: checks._each("images", lambda i: i["lazy"], lambda i: checks._finding(F.lit("lazy"), i["src"])), severity="low", weight=1)
    try:
        return checks.run(extracted(spark, d), disabled=[c[0] for c in catalog.PAGE_CHECKS]).select("page_id", "check_id", "severity", "rule_version")
    finally:
        checks.unregister(own)


@register("join_4_broken_images", f"SELECT k AS page_id, 'images.src.broken' AS check_id, image AS target, 404 AS status FROM {FIELDS_SQL} WHERE length(image) % 7 = 0")
def _(spark, d):
    found = store.kept(extracted(spark, d).select("page_id", "images", F.transform("links", lambda x: F.struct(x["href"])).alias("links")), "pages")
    return crosspage.broken_images(found, link_results(found)).select("page_id", "check_id", "target", "status")


# --- structured data in attributes ---

_ITEM = (
    "concat('<div itemscope itemtype=\"https://schema.org/Product\"><span itemprop=\"name\">', p_name, '</span><div itemprop=\"offers\" itemscope itemtype=\"https://schema.org/Offer\"><meta itemprop=\"price\" content=\"', CAST(p_size AS STRING), '\"></div></div>',"
    " '<section typeof=\"schema:Organization\" resource=\"#o', CAST(p_partkey AS STRING), '\"><b property=\"name\">', p_type, '</b><img property=\"logo\" src=\"/l.png\"></section>',"
    " CASE WHEN p_partkey % 3 = 0 THEN '<script type=\"application/ld+json\">{bad</script>' WHEN p_partkey % 3 = 1 THEN '<script type=\"application/ld+json\">{\"name\": \"untyped\"}</script>' ELSE '' END)"
)


def _items(spark, d) -> DataFrame:
    return structured.extract(f.table(spark, d, "part").selectExpr("p_partkey AS page_id", f"{_ITEM} AS html"))


@register("sd_3_microdata", "SELECT p_partkey AS page_id, 'Product' AS type, p_name AS identity, p_size AS price FROM part")
def _(spark, d):
    rows = _items(spark, d).where("format = 'microdata'")
    return rows.select("page_id", "type", "identity", F.get_json_object("properties", "$.offers.properties.price").cast("int").alias("price"))


@register("sd_4_rdfa", "SELECT p_partkey AS page_id, 'Organization' AS type, '#o' || p_partkey AS id, p_type AS name, '/l.png' AS logo FROM part")
def _(spark, d):
    return _items(spark, d).where("format = 'rdfa'").select("page_id", "type", "id", F.get_json_object("properties", "$.name").alias("name"), F.get_json_object("properties", "$.logo").alias("logo"))


@register("sd_1_parse_errors", "SELECT p_partkey AS page_id, 'json-ld:0' AS location FROM part WHERE p_partkey % 3 = 0")
def _(spark, d):
    return structured.parse_errors(_items(spark, d)).select("page_id", "location")


@register("sd_11_confidence_of_forms", "SELECT page_id, format, c AS confidence FROM (SELECT p_partkey AS page_id, unnest(['microdata', 'rdfa', CASE WHEN p_partkey % 3 = 1 THEN 'json-ld' END]) AS format, unnest([CAST(0.95 AS DOUBLE), 0.75, 0.8]) AS c FROM part) WHERE format IS NOT NULL")
def _(spark, d):
    found = store.kept(_items(spark, d), "entities")
    scores = structured.confidence(found, VOCABULARY)
    return scores.join(found.select("page_id", "pos", "format"), ["page_id", "pos"]).select("page_id", "format", "confidence")


@register("sd_15_entity_rows", "SELECT page_id, type, n FROM (SELECT p_partkey AS page_id, unnest(['Product', 'Organization', CASE WHEN p_partkey % 3 = 1 THEN 'Unknown' END]) AS type, 1 AS n FROM part) WHERE type IS NOT NULL")
def _(spark, d):
    found = store.kept(_items(spark, d), "entities")
    statuses = structured.status(found, structured.validate(found, VOCABULARY))
    return structured.to_rows(found, statuses, structured.confidence(found, VOCABULARY)).groupBy("page_id", "type").agg(F.count("*").cast("int").alias("n"))


#: A type for each brand below those of its parts, so that a type has several parents.
_TYPES = "SELECT DISTINCT p_brand AS type, p_type AS parent FROM part"


@register("sd_7_type_closure", f"SELECT type, type AS ancestor FROM ({_TYPES}) UNION SELECT type, parent FROM ({_TYPES}) UNION SELECT type, 'Thing' FROM ({_TYPES}) UNION SELECT parent, parent FROM ({_TYPES}) UNION SELECT parent, 'Thing' FROM ({_TYPES}) UNION SELECT 'Thing', 'Thing'")
def _(spark, d):
    own = f.table(spark, d, "part").selectExpr("p_brand AS type", "p_type AS parent").distinct()
    upper = own.select(F.col("parent").alias("type"), F.lit("Thing").alias("parent")).distinct()
    types = own.unionByName(upper).groupBy("type").agg(F.collect_set("parent").alias("parents"))
    root = types.limit(1).select(F.lit("Thing").alias("type"), F.array().cast("array<string>").alias("parents"))
    none = types.limit(0).select("type", F.lit("").alias("property"), F.array().cast("array<string>").alias("expected"))
    return structured.Vocabulary.load(types.unionByName(root), none).closure_df(spark).select("type", "ancestor")


@register(
    "udf_3_vocabulary_release",
    """WITH p AS (SELECT DISTINCT p_brand, p_type, 'm' || (p_size % 5) AS m FROM part), e AS (SELECT m, string_agg(c, '|' ORDER BY c) AS expected FROM (SELECT DISTINCT 'm' || (p_size % 5) AS m, 'c' || p_size AS c FROM part) GROUP BY 1)
SELECT known, m AS property, expected FROM (SELECT DISTINCT a.p_brand AS known, b.m FROM p a JOIN p b ON a.p_type = b.p_type UNION SELECT DISTINCT p_type, m FROM p) JOIN e USING (m)
UNION ALL SELECT known, 'name', 'Text' FROM (SELECT p_brand AS known FROM p UNION SELECT p_type FROM p UNION SELECT 'Thing')""",
)
def _(spark, d):
    """Brands below types below Thing, with properties of types by the parts' sizes, as a file in the form of a schema.org release."""
    part = f.table(spark, d, "part").select("p_brand", "p_type", F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("m"), F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("c"))
    ref = lambda c: F.struct(F.concat(F.lit("schema:"), c).alias("@id"))
    of = lambda key, kind, **lists: part.groupBy(F.concat(F.lit("schema:"), key).alias("@id")).agg(F.lit(kind).alias("@type"), *(F.array_sort(F.collect_set(ref(c))).alias(name) for name, c in lists.items()))
    brands = of("p_brand", "rdfs:Class", **{"rdfs:subClassOf": "p_type"})
    types = part.select(F.concat(F.lit("schema:"), "p_type").alias("@id"), F.lit("rdfs:Class").alias("@type"), F.array(ref(F.lit("Thing"))).alias("rdfs:subClassOf")).distinct()
    made = of("m", "rdf:Property", **{"schema:domainIncludes": "p_type", "schema:rangeIncludes": "c"})
    root = spark.sql("SELECT 'schema:Thing' AS `@id`, 'rdfs:Class' AS `@type`")
    name = root.select(F.lit("schema:name").alias("@id"), F.lit("rdf:Property").alias("@type"), F.array(ref(F.lit("Thing"))).alias("schema:domainIncludes"), F.array(ref(F.lit("Text"))).alias("schema:rangeIncludes"))
    graph = [x.select(F.to_json(F.struct("*")).alias("node")) for x in (brands, types, made, root, name)]
    nodes = graph[0].unionByName(graph[1]).unionByName(graph[2]).unionByName(graph[3]).unionByName(graph[4])
    path = store.scratch(spark, "release")
    nodes.agg(F.concat(F.lit('{"@context": {}, "@graph": ['), F.array_join(F.sort_array(F.collect_list("node")), ","), F.lit("]}"))).coalesce(1).write.text(path)
    allowed = structured.Vocabulary.from_release(spark, path).allowed_df(spark)
    return allowed.select("known", "property", F.array_join(F.array_sort("expected"), "|").alias("expected"))


#: A small hierarchy in which a car inherits from a vehicle, a product and a thing.
_CARS = structured.Vocabulary(
    {"Thing": [], "Product": ["Thing"], "Vehicle": ["Product"], "Car": ["Vehicle"], "Offer": ["Thing"]},
    {("Thing", "name"): ["Text"], ("Product", "sku"): ["Integer"], ("Product", "offers"): ["Offer"], ("Vehicle", "sku"): ["Date"], ("Product", "similar"): ["Product"], ("Offer", "availability"): ["ItemAvailability"], ("Offer", "closes"): ["Time"], ("Offer", "bundled"): ["Boolean"]},
)
_KINDS = [
    ("k % 7 = 0", "schema.unknown_type", "warning"),
    ("k % 7 = 1", "schema.car.deprecated.reviews", "warning"),
    ("k % 7 = 1", "schema.car.invalid_property.reviews", "warning"),
    ("k % 7 <> 0 AND k % 3 > 0", "schema.car.type.sku", "fail"),  # a vehicle's date is nearer than a product's number
    ("k % 7 = 2", "schema.offer.type.availability", "fail"),
    ("k % 7 = 3", "schema.offer.type.closes", "fail"),
    ("k % 7 = 3", "schema.offer.type.bundled", "fail"),
    ("k % 7 = 4", "schema.car.type.similar", "fail"),
    ("k % 7 = 6", "schema.car.invalid_property.maker", "warning"),
]


@register("sd_6_validate_kinds", " UNION ALL ".join(f"SELECT p_partkey AS page_id, '{c}' AS check_id, '{status}' AS status FROM (SELECT p_partkey, p_partkey AS k FROM part) WHERE {w}" for w, c, status in _KINDS))
def _(spark, d):
    """Unknown types, superseded and unknown properties, members of enumerations, times, truth values, types by inheritance; what
    an unknown property holds is not judged."""
    k = F.col("p_partkey")
    case = lambda n, then: F.when(k % 7 == n, then)
    offer = F.struct(F.lit("Offer").alias("@type"), F.concat(F.lit("https://schema.org/"), F.when(k % 7 == 2, "Gone").otherwise("InStock")).alias("availability"), F.when(k % 7 == 3, "late").otherwise("2024-05-01T10:00:00Z").alias("closes"), F.when(k % 7 == 3, "perhaps").otherwise("https://schema.org/True").alias("bundled"))
    inner = lambda kind: F.struct(kind.alias("@type"), F.lit("s").alias("name"))
    similar = F.when(k % 7 == 4, inner(F.lit("Offer"))).when(k % 7 == 5, inner(F.lit("Car")))
    item = F.struct(F.when(k % 7 == 0, "Spaceship").otherwise("Car").alias("@type"), F.col("p_name").alias("name"), F.when(k % 3 == 0, "2024-02-29").otherwise("12").alias("sku"), case(1, F.lit("r")).alias("reviews"), offer.alias("offers"), similar.alias("similar"), case(6, inner(F.lit("Spaceship"))).alias("maker"))
    html = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(item), F.lit("</script>"))
    found = store.kept(structured.extract(f.table(spark, d, "part").select(k.alias("page_id"), html.alias("html"))), "entities")
    return structured.validate(found, _CARS).where("check_id NOT LIKE '%.required.%' AND check_id NOT LIKE '%.recommended.%'").select("page_id", "check_id", "status")


@register("udf_6_rule_version", f"SELECT 'finding' AS kind, '{catalog.VERSION}' AS rule_version, count(*) AS n FROM {FIELDS_SQL} WHERE title IS NULL UNION ALL SELECT 'entity', '{catalog.VERSION}', count(*) FROM {_ENTITIES}")
def _(spark, d):
    others = [c[0] for c in catalog.PAGE_CHECKS if c[0] != "meta.title.missing"]
    found = _marked_once(spark, d)
    rows = structured.to_rows(found, structured.status(found, structured.validate(found, VOCABULARY)), structured.confidence(found, VOCABULARY))
    both = checks.run(extracted(spark, d), disabled=others).select(F.lit("finding").alias("kind"), "rule_version").unionByName(rows.select(F.lit("entity").alias("kind"), "rule_version"))
    return both.groupBy("kind", "rule_version").agg(F.count("*").alias("n"))


@register(
    "agg_7_schema_block",
    f"SELECT count(*) AS entity_count, count(*) FILTER (WHERE s = 'errors') AS errors, count(*) FILTER (WHERE s = 'warnings') AS warnings, CAST(round(100 * (0.7 * count(*) FILTER (WHERE s = 'warnings') + 0.2 * count(*) FILTER (WHERE s = 'errors')) / count(*)) AS INT) AS health,"
    f" 'Product:eligible_with_warnings=' || count(*) FILTER (WHERE v <> 'ineligible') || '|Product:ineligible=' || count(*) FILTER (WHERE v = 'ineligible') AS rich, 'Product=' || count(*) AS types FROM (SELECT {_STATUS} AS s, {_VERDICT} AS v FROM {_ENTITIES})",
)
def _(spark, d):
    found = _marked_once(spark, d)
    statuses = structured.status(found, structured.validate(found, VOCABULARY))
    judged = store.kept(found.select(*structured.KEY, "type").join(statuses, structured.KEY), "judged")
    schema = scoring.schema_metrics(judged, structured.rich_results(found))
    row = scoring.crawl_metrics(_scored(spark, d), f.issues(spark, d), f.link_checks(spark, d), schema)
    s = F.col("schema")
    told = lambda name, key: F.array_join(F.transform(s[name], lambda x: F.concat(key(x), F.lit("="), x["n"].cast("string"))), "|")
    n = lambda k: F.coalesce(F.try_element_at(s["status_counts"], F.lit(k)), F.lit(0)).alias(k)
    return row.select(s["entity_count"].alias("entity_count"), n("errors"), n("warnings"), s["health"].alias("health"), told("rich_summary", lambda x: F.concat(x["profile"], F.lit(":"), x["status"])).alias("rich"), told("top_types", lambda x: x["type"]).alias("types"))


# --- what else had no rows of its own ---


@register("snk_8_catalog", "SELECT check_id, default_severity AS severity, weight, count(l.page_id) AS n FROM " + f.CHECKS_SQL + " c LEFT JOIN (SELECT check_id, page_id FROM " + f.ISSUES_SQL + ") l USING (check_id) GROUP BY ALL")
def _(spark, d):
    path = store.scratch(spark, "catalog")
    store.upsert_catalog(catalog.as_df(spark).withColumn("severity", F.lit("old")), path)
    store.upsert_catalog(catalog.as_df(spark), path)
    counts = f.issues(spark, d).groupBy("check_id").agg(F.count("*").alias("n"))
    rows = store.facts(spark, path, "catalog").join(counts, "check_id", "left")
    return rows.select("check_id", "severity", F.col("weight").cast("int").alias("weight"), F.coalesce("n", F.lit(0)).alias("n"))


@register("win_6_first_entity_wins", "SELECT page_id, key, pos FROM (SELECT l_partkey AS page_id, 'Offer::' || l_returnflag AS key, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pos, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def _(spark, d):
    rows = f.table(spark, d, "lineitem").select(F.col("l_partkey").alias("page_id"), F.lit("Offer").alias("type"), F.col("l_returnflag").alias("identity"), F.lit("").alias("entity_hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return history._keyed(rows).select("page_id", "key", F.col("pos").cast("long").alias("pos"))


@register("join_12_carried_issues", "SELECT l_suppkey + 1000000 AS crawl_id, l_partkey AS page_id, count(*) AS n FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY ALL")
def _(spark, d):
    issues = f.issues(spark, d).select("crawl_id", "page_id", "check_id")
    carried = issues.where("page_id % 2 = 0").select((F.col("crawl_id") + 1000000).alias("crawl_id"), "page_id", F.col("crawl_id").alias("previous_crawl_id")).distinct()
    return history.carry_children(carried, issues).groupBy("crawl_id", "page_id").agg(F.count("*").alias("n"))


#: Findings of the pages that need no link results.
_OWN_FINDINGS = " UNION ALL ".join(f"SELECT k FROM {FIELDS_SQL} WHERE {w}" for c, w in _CASES if "broken" not in c and "chain" not in c)
_BLOCK = "concat('<script type=\"application/ld+json\">{\"@type\": \"Product\"', CASE WHEN page_id % 4 = 0 THEN ', \"name\": \"n\", \"image\": \"https://e.org/i.png\"' ELSE '' END, '}</script>')"


@register(
    "str_7_ingest",
    f"""SELECT k AS page_id, coalesce(title, '(none)') AS title, 9 AS crawl_id, coalesce(n, 0) AS n_findings, CASE k % 4 WHEN 0 THEN 'Product:warnings' WHEN 2 THEN 'Product:errors' ELSE '' END AS entities
FROM {FIELDS_SQL} LEFT JOIN (SELECT k, count(*) AS n FROM ({_OWN_FINDINGS}) GROUP BY 1) USING (k)""",
)
def _(spark, d):
    path = store.scratch(spark, "ingest")
    made = pages(spark, d)
    made = made.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.expr(f"replace(html, '<script>var x = 1</script>', {_BLOCK})")).otherwise(F.col("html")))
    made.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(made.schema).parquet(f"{path}/in")
    for k in range(2):  # the second run starts anew and replaces what is there
        progress.ingest(stream, f"{path}/out", f"{path}/state{k}", 9, VOCABULARY).awaitTermination()
    read = lambda name: store.facts(spark, f"{path}/out", name)
    issues = read("issues").groupBy("page_id").agg(F.count("*").alias("n_findings"))
    own = read("entities").groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", "status"))), ",").alias("entities"))
    out = read("snapshots").select("page_id", "title", "crawl_id").join(issues, "page_id", "left").join(own, "page_id", "left")
    return out.select("page_id", F.coalesce("title", F.lit("(none)")).alias("title"), F.col("crawl_id").cast("int").alias("crawl_id"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("entities", F.lit("")).alias("entities"))


@register("str_8_trend_sink", "SELECT website_id, day, crawl_id FROM (SELECT o_custkey AS website_id, CAST(o_orderdate AS DATE) AS day, o_orderkey AS crawl_id, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def _(spark, d):
    path = store.scratch(spark, "trend")
    rows = f.table(spark, d, "orders").select(F.col("o_custkey").alias("website_id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderkey").alias("crawl_id"), (F.col("o_orderkey") % 100).cast("double").alias("score"))
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    progress.trend_sink(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return store.facts(spark, f"{path}/out", "trend").select("website_id", "day", "crawl_id")


@register("issue_changes_both_ways", "SELECT DISTINCT 'c' || l_orderkey AS fingerprint, CASE WHEN l_orderkey % 2 = 0 THEN 'introduced' ELSE 'resolved' END AS state FROM lineitem WHERE (l_orderkey % 2 = 0) = (l_orderkey % 3 = 0)")
def _(spark, d):
    rows = f.table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("fingerprint"))
    return history.issue_changes(rows.where("l_orderkey % 3 <> 0"), rows.where("l_orderkey % 2 = 0"))


@register("agg_14_pages_without_entities", "SELECT count(*) FILTER (WHERE p_partkey % 3 <> 1) AS n FROM part")
def _(spark, d):
    """Entities in JSON-LD are counted by page; the other notations are left out, since every page has them."""
    having = structured.entities(_items(spark, d)).where("format = 'json-ld'").agg(F.count_distinct("page_id").alias("having"))
    both = f.table(spark, d, "part").agg(F.count("*").alias("scored")).join(having)  # one row each
    return both.select(reports.pages_without_schema(F.col("scored"), F.col("having")).alias("n"))


@register("url_7_same_origin_as_the_page_before", "SELECT a.page_id, lower(regexp_extract(a.url, '^(https?://[^/?#]+)', 1)) = lower(regexp_extract(b.url, '^(https?://[^/?#]+)', 1)) AS same FROM pages a JOIN pages b ON b.page_id = a.page_id - 1")
def _(spark, d):
    pages_ = f.table(spark, d, "pages").select("page_id", "url")
    before = pages_.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("other"))
    return pages_.join(before, "page_id").select("page_id", urls.same_origin("url", "other").alias("same"))


_FACTS = ("snapshots", "issues", "entities", "changes", "link_checks", "hints", "progress")


@register("snk_7_remove_group_everywhere", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = {k} AND o_orderpriority <> '2-HIGH'" for k, name in enumerate(_FACTS, 1)) + " UNION ALL SELECT 'crawls', count(*) FROM orders WHERE o_orderpriority <> '2-HIGH' UNION ALL SELECT 'aggregates', count(*) FROM orders WHERE o_orderpriority <> '2-HIGH' UNION ALL SELECT 'pages', count(*) FROM part")
def _(spark, d):
    """Facts of every kind, a line of an order each; the dimension of pages has no crawl and stays."""
    lines = f.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("crawl_id"), "l_linenumber")
    tables = {name: lines.where(F.col("l_linenumber") == k) for k, name in enumerate(_FACTS, 1)}
    left = store.remove_group(tables | {"crawls": f.crawls(spark, d), "aggregates": f.aggregates(spark, d), "pages": f.table(spark, d, "part")}, "2-HIGH")
    out = None
    for name, frame in left.items():
        row = frame.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@register("sd_13_singletons", "SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'schema.page.conflicting' ELSE 'schema.page.duplicate' END AS check_id, 'WebSite' AS entity_type, 2 AS n FROM part WHERE p_partkey % 3 < 2")
def _(spark, d):
    """Two sites on a page that differ, two that are the same, and one."""
    k = F.col("p_partkey")
    site = lambda name: F.concat(F.lit('<script type="application/ld+json">{"@type": "WebSite", "name": "'), name, F.lit('"}</script>'))
    html = F.concat(site(F.lit("a")), F.when(k % 3 == 0, site(F.lit("b"))).when(k % 3 == 1, site(F.lit("a"))).otherwise(F.lit("")))
    found = structured.extract(f.table(spark, d, "part").select(k.alias("page_id"), html.alias("html")))
    return structured.page_checks(structured.entities(found)).withColumn("n", F.col("n").cast("int"))


@register("udf_5_links_in_sql", f"SELECT page_id, pos, url, text, internal FROM {f.LINKS_SQL}")
def _(spark, d):
    tables.register_all(spark)
    return spark.sql("SELECT p.page_id, l.pos, l.href AS url, l.text, l.internal FROM {pages} p, LATERAL extract_links(p.html, p.url) l", pages=f.table(spark, d, "pages"))

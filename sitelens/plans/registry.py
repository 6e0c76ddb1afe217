"""Registered queries over the given tables, and the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import urls
from ..operators import artifacts, checks, crosspage, history, reports, scoring
from ..sources import readers, store
from ..streaming import progress
from . import frames as f

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


def _joined(column, sep: str = "|"):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


# --- the whole way: pages to artifacts, findings and scores ---


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the page checks and of duplicate titles and headings; pages are parsed once."""
    pages = f.extracted(spark, sf_dir).persist()
    found = checks.run(pages).select("page_id", "check_id", "severity")
    across = [crosspage.duplicate_issues(pages, k).select("page_id", "check_id", "severity") for k in ("title", "h1")]
    return found.unionByName(across[0]).unionByName(across[1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages score worst and why: score and counts of findings by severity for each page."""
    pages = f.table(spark, sf_dir, "pages").select("page_id", "url", F.lit(100.0).alias("score"))
    found = page_findings(spark, sf_dir).persist()  # read by the scores and by the counts
    counts = scoring.issue_counts(found)
    n = lambda k: F.coalesce(F.element_at("issue_counts", F.lit(k)), F.lit(0)).alias(k)
    return scoring.rescore(pages, found).join(counts, "page_id", "left").select("page_id", "url", "score", *map(n, catalog.SEVERITIES))


#: Findings of the given pages in SQL: those checks that can occur on them.
_OWN = "(SELECT *, count(*) OVER (PARTITION BY lower(title)) AS same_title, count(*) OVER (PARTITION BY lower(h1)) AS same_h1 FROM " + f.PAGES_SQL + ")"
_GENERIC = "(" + ", ".join(f"'{phrase}'" for phrase in ["", *checks.GENERIC]) + ")"
_PAGE_ISSUES_SQL = "(" + " UNION ALL ".join(
    f"SELECT page_id, '{check}' AS check_id FROM {_OWN} WHERE {when}"
    for check, when in [
        ("meta.title.empty", "title = ''"),
        ("meta.title.too_long", "length(title) > 60"),
        ("meta.title.too_short", "length(title) > 0 AND length(title) < 10"),
        ("meta.description.missing", "true"),
        ("meta.canonical.missing", "true"),
        ("meta.viewport.missing", "true"),
        ("meta.lang.missing", "lang = ''"),
        ("headings.h1.duplicate_of_title", "title <> '' AND lower(title) = lower(h1)"),
        ("headings.any.empty", "h1 = ''"),
        ("technical.https.not_secure", "url LIKE 'http://%'"),
        ("social.og.missing_required", "true"),
        ("social.twitter.missing_card", "true"),
        ("duplicate.title", "title <> '' AND same_title > 1"),
        ("duplicate.h1", "h1 <> '' AND same_h1 > 1"),
    ]
) + f" UNION ALL SELECT page_id, 'links.anchor.empty_or_generic' AS check_id FROM {f.LINKS_SQL} WHERE lower(trim(text)) IN {_GENERIC})"


def _scores_sql(issues: str, unknown: int = catalog.UNKNOWN_WEIGHT) -> str:
    return f"(SELECT page_id, round(greatest(0, least(100, 100 - sum(coalesce(weight, {unknown}) * (1 + log2(n) * 0.1) * mult))), 2) AS score FROM (SELECT page_id, check_id, severity, count(*) AS n FROM {issues} GROUP BY ALL) i LEFT JOIN {f.CHECKS_SQL} c USING (check_id) JOIN {f.MULTIPLIERS_SQL} m USING (severity) GROUP BY page_id)"


_WITH_SEVERITY = f"(SELECT page_id, check_id, default_severity AS severity FROM {_PAGE_ISSUES_SQL} JOIN {f.CHECKS_SQL} USING (check_id))"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in catalog.SEVERITIES)


@register("flagship_page_scores", f"SELECT p.page_id, p.url, coalesce(s.score, 100.0) AS score, {', '.join(f'CAST(coalesce({s}, 0) AS INT) AS {s}' for s in catalog.SEVERITIES)} FROM pages p LEFT JOIN {_scores_sql(_WITH_SEVERITY)} s USING (page_id) LEFT JOIN (SELECT page_id, {_COUNTS} FROM {_WITH_SEVERITY} GROUP BY page_id) USING (page_id)")
def _(spark, d):
    return flagship(spark, d)


@register("chk_page_findings", f"SELECT page_id, check_id, severity, count(*) AS n FROM {_WITH_SEVERITY} GROUP BY ALL")
def _(spark, d):
    return page_findings(spark, d).groupBy("page_id", "check_id", "severity").agg(F.count("*").alias("n"))


# --- sources and sinks ---


@register("src_1_read_pages", "SELECT page_id, url, url AS final_url, 200 AS http_status, length(html) AS n FROM pages")
def _(spark, d):
    return readers.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", "final_url", "http_status", F.length("html").cast("long").alias("n"))


@register("src_2_manual_urls", "SELECT DISTINCT trim(url) AS url, regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages WHERE trim(url) <> ''")
def _(spark, d):
    return readers.manual_urls(f.table(spark, d, "pages"))


@register("src_4_csv_gate", "SELECT count(*) AS row_count, count(*) FILTER (WHERE page_id % 50 <> 0) AS valid_count, (SELECT string_agg(u, '|' ORDER BY u) FROM (SELECT DISTINCT concat('bad:', url) AS u FROM pages WHERE page_id % 50 = 0 ORDER BY u LIMIT 5)) AS samples, count(*) FILTER (WHERE page_id % 50 = 0) <= 0.05 * count(*) AS accepted FROM pages")
def _(spark, d):
    given = f.table(spark, d, "pages").select(F.when(F.col("page_id") % 50 == 0, F.concat(F.lit("bad:"), "url")).otherwise(F.col("url")).alias("url"))
    return readers.validate_csv_urls(given).select("row_count", "valid_count", F.array_join("invalid_samples", "|").alias("samples"), "accepted")


@register("src_8_discovery_seeds", "SELECT DISTINCT url, true AS allow_discovery FROM pages WHERE lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) = (SELECT lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) FROM pages WHERE page_id = 0)")
def _(spark, d):
    pages = f.table(spark, d, "pages")
    first = pages.where("page_id = 0").select(urls.origin("url")).first()
    return readers.discovery_seeds(pages, first[0] if first else "")


@register("set_1_resolve_seeds", "SELECT u AS url, bool_or(page_id % 3 = 0) AS allow_discovery, min(page_id % 3) AS source_no FROM (SELECT page_id, concat('https://', lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '/') AS u FROM pages) GROUP BY u")
def _(spark, d):
    base = f.table(spark, d, "pages").select("page_id", F.concat(F.lit("HTTPS://"), F.upper(urls.host("url")), F.lit("#x")).alias("url"))
    parts = [base.where(F.col("page_id") % 3 == k).select("url", F.lit(k == 0).alias("allow_discovery")) for k in range(3)]
    return readers.resolve_seeds(parts).select("url", "allow_discovery", F.col("source_no").cast("long").alias("source_no"))


@register("set_2_lastmod", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS lastmod FROM events")
def _(spark, d):
    given = F.when(F.col("event_id") % 4 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return f.table(spark, d, "events").select("event_id", F.date_format(readers.parse_lastmod(given), "yyyy-MM-dd").alias("lastmod"))


@register("set_3_seeds_for_crawls", "SELECT o_orderkey AS crawl_id, CASE o_orderkey % 3 WHEN 0 THEN concat('/page/', CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN concat('/group/', CAST(g AS VARCHAR)) ELSE concat('/site/', CAST(g AS VARCHAR)) END AS url, o_orderkey % 3 = 2 AS allow_discovery FROM orders JOIN (SELECT unnest([0, 1]) AS g) ON o_orderkey % 3 > 0 OR g = 0")
def _(spark, d):
    number = F.col("o_orderkey") % 3
    scope = F.when(number == 0, "page").when(number == 1, "group").otherwise("site")
    runs = f.table(spark, d, "orders").select(F.col("o_orderkey").alias("crawl_id"), scope.alias("scope"), F.concat(F.lit("/page/"), F.col("o_orderkey").cast("string")).alias("target_url"), F.lit(1).alias("group_id"), F.lit(1).alias("website_id"))
    two = spark.range(2).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("g"))
    return readers.seeds_for_crawls(runs, two.select(F.col("k").alias("group_id"), F.concat(F.lit("/group/"), "g").alias("url")), two.select(F.col("k").alias("website_id"), F.concat(F.lit("/site/"), "g").alias("url"), F.lit(True).alias("allow_discovery")))


@register("snk_3_insert_link_checks", "SELECT l_orderkey AS crawl_id, CASE WHEN sum(CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END) > 0 THEN 'old' ELSE 'new' END AS origin FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    rows = f.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("crawl_id"), F.lit("u").alias("url"), "l_linenumber")
    old = rows.where("l_linenumber <= 2").select("crawl_id", "url").distinct().withColumn("origin", F.lit("old"))
    return store.insert_link_checks(old, rows.where("l_linenumber > 2").select("crawl_id", "url", F.lit("new").alias("origin"))).select("crawl_id", "origin")


@register("snk_4_upsert_pages", "SELECT o_custkey AS website_id, o_orderpriority AS url, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, NOT bool_or(o_orderkey % 2 = 1) AND bool_or(o_orderkey % 2 = 0) AS is_deleted FROM orders GROUP BY 1, 2")
def _(spark, d):
    rows = f.table(spark, d, "orders").select(F.col("o_custkey").alias("website_id"), F.col("o_orderpriority").alias("url"), "o_orderdate", "o_orderkey")
    old = rows.where("o_orderkey % 2 = 0").groupBy("website_id", "url").agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen")).withColumn("is_deleted", F.lit(True))
    out = store.upsert_pages(old, rows.where("o_orderkey % 2 = 1").select("website_id", "url", F.col("o_orderdate").alias("seen_at")))
    return out.withColumn("first_seen", F.col("first_seen")).join(rows.groupBy("website_id", "url").agg(F.min("o_orderdate").alias("m")), ["website_id", "url"]).select("website_id", "url", F.least("first_seen", "m").alias("first_seen"), "last_seen", "is_deleted")


@register("snk_5_upsert_latest", "SELECT website_id, day, crawl_id FROM (SELECT website_id, CAST(created_at AS DATE) AS day, crawl_id, row_number() OVER (PARTITION BY website_id, CAST(created_at AS DATE) ORDER BY created_at DESC, crawl_id DESC) AS n FROM " + f.CRAWLS_SQL + ") WHERE n = 1")
def _(spark, d):
    rows = f.crawls(spark, d).select("website_id", F.to_date("created_at").alias("day"), "crawl_id", "created_at")
    best = store.upsert_latest(rows.where("crawl_id % 2 = 0"), rows.where("crawl_id % 2 = 1"), ["website_id", "day"], [F.desc("created_at"), F.desc("crawl_id")])
    return best.select("website_id", "day", "crawl_id")


@register("snk_6_link_pages", "SELECT l_partkey AS page_id, l_suppkey AS group_id, max(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate END) AS lastmod FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    rows = f.table(spark, d, "lineitem").select(F.col("l_partkey").alias("page_id"), F.col("l_suppkey").alias("group_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate")).alias("lastmod"), "l_linenumber")
    return store.link_pages(rows.where("l_linenumber < 3").drop("l_linenumber"), rows.where("l_linenumber >= 3").drop("l_linenumber"))


@register("snk_7_remove_group", f"SELECT 'crawls' AS name, crawl_id AS id FROM {f.CRAWLS_SQL} WHERE group_id IS NULL OR group_id <> '2-HIGH' UNION ALL SELECT 'aggregates', crawl_id FROM {f.AGGREGATES_SQL} WHERE crawl_id NOT IN (SELECT crawl_id FROM {f.CRAWLS_SQL} WHERE group_id = '2-HIGH')")
def _(spark, d):
    left = store.remove_group({"crawls": f.crawls(spark, d), "aggregates": f.aggregates(spark, d)}, "2-HIGH")
    return left["crawls"].select(F.lit("crawls").alias("name"), F.col("crawl_id").alias("id")).unionByName(left["aggregates"].select(F.lit("aggregates").alias("name"), F.col("crawl_id").alias("id")))


@register("snk_9_archive_bodies", "SELECT DISTINCT concat('raw/', substr(sha256(text), 1, 2), '/', sha256(text), '.html') AS key, sha256(text) AS content_hash, text AS body FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return store.archive_bodies(f.table(spark, d, "documents"), "text")


@register("snk_10_csv_guard", "SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+@-]') THEN concat('''', t) ELSE t END AS cell FROM (SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END, source) AS t FROM documents)")
def _(spark, d):
    mark = F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    return f.table(spark, d, "documents").select("doc_id", store.guarded(F.concat(mark, "source")).alias("cell"))


# --- URL functions ---


@register("url_1_normalize", "SELECT page_id, concat(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)), regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) = '' THEN '' ELSE concat('?', regexp_extract(url, '[?]([^#]*)', 1)) END) AS url FROM pages")
def _(spark, d):
    return f.table(spark, d, "pages").select("page_id", urls.normalize("url").alias("url"))


@register("url_2_hash", "SELECT page_id, sha256(url) AS url_hash FROM pages")
def _(spark, d):
    return f.table(spark, d, "pages").select("page_id", urls.url_hash("url").alias("url_hash"))


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@register("url_3_registrable_domain", f"SELECT page_id, CASE WHEN len(l) <= 2 THEN h WHEN l[-2] IN ('co','com','net','org','gov','ac','edu') THEN concat(l[-3], '.', l[-2], '.', l[-1]) ELSE concat(l[-2], '.', l[-1]) END AS domain FROM (SELECT page_id, h, string_split(h, '.') AS l FROM (SELECT page_id, concat({_HOST}, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.uk' ELSE '.com.au' END) AS h FROM pages))")
def _(spark, d):
    more = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, ".uk").otherwise(".com.au")
    return f.table(spark, d, "pages").select("page_id", urls.registrable_domain(F.concat(F.upper(urls.host("url")), more)).alias("domain"))


@register("url_4_resolve", f"SELECT page_id, pos, url FROM {f.LINKS_SQL}")
def _(spark, d):
    return f.links(spark, d).select("page_id", "pos", "url")


@register("url_5_parts", f"SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, regexp_replace({_HOST}, '^www\\.', '') AS host, CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS path FROM pages")
def _(spark, d):
    return f.table(spark, d, "pages").select("page_id", urls.origin("url").alias("origin"), urls.host_no_www("url").alias("host"), urls.path_of("url").alias("path"))


@register("url_6_is_http", "SELECT doc_id, doc_id % 3 = 1 AS ok FROM documents")
def _(spark, d):
    lead = F.when(F.col("doc_id") % 3 == 0, "mailto:").when(F.col("doc_id") % 3 == 1, "HTTPS://").otherwise("ftp://")
    return f.table(spark, d, "documents").select("doc_id", urls.is_http(F.concat(lead, "source")).alias("ok"))


@register("url_7_same_origin", "SELECT count(*) AS n FROM pages WHERE lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) = 'https://m.ththth.example.net'")
def _(spark, d):
    return f.table(spark, d, "pages").where(urls.same_origin("url", F.lit("https://m.ththth.example.net/x"))).agg(F.count("*").alias("n"))


@register("url_8_last_segment", "SELECT page_id, coalesce(nullif(regexp_replace(split_part(url, '?', 1), '^.*/([^/]+)$', '\\1'), ''), 'Sitemap') AS name FROM pages")
def _(spark, d):
    return f.table(spark, d, "pages").select("page_id", urls.last_segment("url").alias("name"))


# --- filters ---


@register("flt_1_scope", "SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.com([/?#]|$)') OR NOT (p = '/en' OR p LIKE '/en/%') THEN 'out_of_scope' WHEN regexp_matches(p, '^/en/[^/]*7[^/]*$') THEN 'blocked' ELSE 'in_scope' END AS class FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)")
def _(spark, d):
    rows = f.table(spark, d, "pages").select("page_id", "url")
    return rows.select("page_id", readers.scope_class("url", "https://a.example.com", "/en", block=["/en/*7*"]).alias("class"))


@register("flt_5_issue_page", f"SELECT id, severity, created_at, url, count(*) OVER () > 50 AS has_more FROM (SELECT i.id, i.severity, i.created_at, p.url, row_number() OVER (ORDER BY i.created_at, i.id) AS n FROM {f.ISSUES_SQL} i JOIN {f.PAGE_DIM_SQL} p USING (page_id) WHERE i.crawl_id = 7 AND i.severity IN ('critical', 'high')) WHERE n <= 51 QUALIFY n <= 50")
def _(spark, d):
    return reports.issues(f.issues(spark, d), f.page_dim(spark, d), 7, severity=["critical", "high"]).select("id", "severity", "created_at", "url", "has_more")


@register("flt_6_snapshots", f"SELECT id, created_at, url FROM {f.ISSUES_SQL} JOIN {f.PAGE_DIM_SQL} USING (page_id) WHERE crawl_id = 3 AND fetch_status = 'error' ORDER BY created_at, id LIMIT 200")
def _(spark, d):
    return reports.snapshots(f.issues(spark, d), f.page_dim(spark, d), 3, fetch_status="error", limit=200).select("id", "created_at", "url")


@register("flt_9_failed_pages", f"SELECT id, url FROM {f.ISSUES_SQL} JOIN {f.PAGE_DIM_SQL} USING (page_id) WHERE fetch_status = 'error'")
def _(spark, d):
    return reports.failed_pages(f.issues(spark, d), f.page_dim(spark, d)).select("id", "url")


@register("flt_10_stuck_crawls", f"SELECT crawl_id FROM {f.CRAWLS_SQL} WHERE finished_at IS NULL AND created_at < TIMESTAMP '1997-01-01' AND (status = 'finalizing' OR (status = 'running' AND total > 0 AND crawled + unchanged + failed >= total))")
def _(spark, d):
    return reports.stuck_crawls(f.with_stats(f.crawls(spark, d)), F.expr("TIMESTAMP_NTZ '1997-01-01'")).select("crawl_id")


@register("flt_11_active_conflicts", f"SELECT r.crawl_id AS request_id, arg_max(a.crawl_id, struct_pack(t := a.created_at, c := a.crawl_id)) AS crawl_id FROM {f.CRAWLS_SQL} r JOIN {f.CRAWLS_SQL} a ON a.website_id = r.website_id AND a.status IN ('running', 'finalizing') AND (r.group_id IS NULL OR a.group_id IS NULL OR a.group_id = r.group_id) GROUP BY 1")
def _(spark, d):
    runs = f.crawls(spark, d)
    return reports.active_conflicts(runs, runs.select(F.col("crawl_id").alias("request_id"), "website_id", "group_id"))


@register("flt_12_visible_projects", f"SELECT project_id, project_name FROM {f.PROJECTS_SQL} WHERE deleted_at IS NULL AND project_id IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 = 4)")
def _(spark, d):
    members = f.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("project_id"), (F.col("c_custkey") % 10).alias("user_id"))
    return reports.visible_projects(f.projects(spark, d), members, 4).select("project_id", "project_name")


@register("flt_13_needs_render", "SELECT page_id, page_id % 4 = 0 AS needs FROM pages")
def _(spark, d):
    shell = F.concat(F.lit("<div id='root'></div><script>"), "html", F.lit("</script>"))
    bare = F.when(F.col("page_id") % 4 == 0, F.regexp_replace(shell, "(?is)<script>.*", "<script>x</script>")).otherwise(F.col("html"))
    return f.table(spark, d, "pages").select("page_id", artifacts.needs_render(bare).alias("needs"))


# --- artifacts ---


@register("ext_fields", f"SELECT page_id, title, 'utf-8' AS charset, nullif(lang, '') AS html_lang, url LIKE 'https:%' AS https, md5(lower(title)) AS title_hash, nullif(h1, '') AS h1_text, CASE WHEN h1 = '' THEN NULL ELSE md5(lower(h1)) END AS h1_hash FROM {f.PAGES_SQL}")
def _(spark, d):
    return f.extracted(spark, d).select("page_id", "title", "charset", "html_lang", "https", "title_hash", "h1_text", "h1_hash")


@register("ext_7_headings", f"SELECT page_id, 1 AS level, h1 AS text FROM {f.PAGES_SQL}")
def _(spark, d):
    return f.extracted(spark, d).select("page_id", F.explode("headings").alias("h")).select("page_id", "h.level", "h.text")


@register("ext_9_links", f"SELECT page_id, pos, url, text, internal FROM {f.LINKS_SQL}")
def _(spark, d):
    return f.links(spark, d)


@register("ext_12_word_count", "SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '<head>.*</head>', '', 's'), '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g'), '[^\\s]+')) AS INT) AS word_count FROM pages")
def _(spark, d):
    return f.extracted(spark, d).select("page_id", "word_count")


@register("ext_19_content_hash", "SELECT page_id, sha256(html) AS content_hash FROM pages")
def _(spark, d):
    return f.table(spark, d, "pages").select("page_id", artifacts.content_hash(F.col("html")).alias("content_hash"))


@register("chk_37_40_status", f"SELECT page_id, check_id FROM (SELECT page_id, unnest([CASE WHEN http_status = 404 THEN 'technical.status.4xx' END, CASE WHEN http_status = 500 THEN 'technical.status.5xx' END, CASE WHEN hops > 0 THEN 'technical.redirect.present' END]) AS check_id FROM {f.PAGES_SQL}) WHERE check_id IS NOT NULL")
def _(spark, d):
    found = checks.run(artifacts.extract(f.fetched(spark, d)))
    return found.where(F.col("check_id").isin("technical.status.4xx", "technical.status.5xx", "technical.redirect.present")).select("page_id", "check_id")


@register("chk_44_status_error", f"SELECT page_id, 'technical.status.error' AS check_id FROM {f.PAGES_SQL} WHERE http_status >= 400")
def _(spark, d):
    return checks.fetch_issues(f.fetched(spark, d)).select("page_id", "check_id")


@register("chk_46_overrides", f"SELECT page_id, check_id, CASE check_id WHEN 'meta.title.too_long' THEN 'high' ELSE default_severity END AS severity FROM {_PAGE_ISSUES_SQL} JOIN {f.CHECKS_SQL} USING (check_id) WHERE check_id LIKE 'meta.title.%'")
def _(spark, d):
    others = [c[0] for c in catalog.PAGE_CHECKS if not c[0].startswith("meta.title.")]
    return checks.run(f.extracted(spark, d), disabled=others, severity={"meta.title.too_long": "high"}).select("page_id", "check_id", "severity")


@register("chk_47_fingerprint", f"SELECT page_id, sha256(concat('technical.https.not_secure:', url, ':delivered without TLS: ', url)) AS fingerprint FROM {f.PAGES_SQL} WHERE url LIKE 'http://%'")
def _(spark, d):
    found = checks.run(f.extracted(spark, d)).where("check_id = 'technical.https.not_secure'")
    return checks.fingerprint(found).select("page_id", "fingerprint")


@register("chk_48_fetch_status", f"SELECT page_id, CASE WHEN http_status >= 400 THEN 'error' WHEN hops > 0 THEN 'redirected' ELSE 'ok' END AS fetch_status FROM {f.PAGES_SQL}")
def _(spark, d):
    return checks.fetch_status(f.fetched(spark, d)).select("page_id", "fetch_status")


# --- joins across pages ---


@register("agg_1_duplicate_groups", f"SELECT 'title' AS field, md5(md5(lower(title))) AS value_hash, min(title) AS sample, string_agg(CAST(page_id AS VARCHAR), '|' ORDER BY page_id) AS page_ids, count(*) AS page_count FROM {f.PAGES_SQL} WHERE title <> '' GROUP BY lower(title) HAVING count(*) > 1")
def _(spark, d):
    return crosspage.duplicate_groups(f.extracted(spark, d), "title").select("field", "value_hash", "sample", _joined("page_ids").alias("page_ids"), "page_count")


@register("join_2_duplicate_issues", f"SELECT page_id, 'duplicate.h1' AS check_id, 'medium' AS severity, h1 AS value, n AS duplicate_count, sha256(concat('1:', CAST(page_id AS VARCHAR), ':duplicate.h1')) AS fingerprint FROM (SELECT page_id, h1, count(*) OVER (PARTITION BY lower(h1)) AS n FROM {f.PAGES_SQL} WHERE h1 <> '') WHERE n > 1")
def _(spark, d):
    return crosspage.duplicate_issues(f.extracted(spark, d), "h1").drop("field")


_FIRST = f"(SELECT page_id, url, min_by(text, pos) AS text FROM {f.LINKS_SQL} GROUP BY page_id, url)"


@register("join_3_broken_links", f"SELECT page_id, 'links.internal.broken' AS check_id, 'critical' AS severity, l.url AS target, c.status, l.text AS anchor, sha256(concat(CAST(page_id AS VARCHAR), ':', l.url, ':broken')) AS fingerprint FROM {_FIRST} l JOIN {f.LINK_CHECKS_SQL} c USING (url) WHERE NOT ok")
def _(spark, d):
    pages = store.kept(f.extracted(spark, d).select("page_id", "links"), "links")
    return crosspage.broken_links(pages, f.link_checks(spark, d, pages)).select("page_id", "check_id", "severity", "target", "status", "anchor", "fingerprint")


@register("join_5_redirect_chains", f"SELECT page_id, l.url AS target, c.redirect_hops AS hops, l.text AS anchor FROM {_FIRST} l JOIN {f.LINK_CHECKS_SQL} c USING (url) WHERE redirect_hops > 2")
def _(spark, d):
    pages = store.kept(f.extracted(spark, d).select("page_id", "links"), "links")
    return crosspage.redirect_chains(pages, f.link_checks(spark, d, pages)).select("page_id", "target", "hops", "anchor")


@register("join_14_classify_links", "SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 405 ELSE 500 END AS INT) AS status, doc_id % 5 < 2 AS ok, doc_id % 2 = 0 AS is_internal, doc_id % 5 = 3 AS retry_with_get FROM documents")
def _(spark, d):
    code = F.element_at(F.array(*map(F.lit, [200, 301, 404, 405, 500])), (F.col("doc_id") % 5 + 1).cast("int"))
    host = F.when(F.col("doc_id") % 2 == 0, "https://blog.example.com/").otherwise("https://example.net/")
    results = f.table(spark, d, "documents").select(F.lit(1).alias("website_id"), F.concat(host, F.col("doc_id").cast("string")).alias("url"), code.alias("status"), F.lit(0).alias("redirect_hops"))
    sites = spark.range(1).select(F.lit(1).alias("website_id"), F.lit("https://www.example.com").alias("origin"))
    return crosspage.classify_links(results, sites).select(F.element_at(F.split("url", "/"), -1).cast("long").alias("doc_id"), "status", "ok", "is_internal", "retry_with_get")


@register("set_4_link_targets", f"SELECT DISTINCT url FROM {f.LINKS_SQL} WHERE page_id % 2 = 0 AND url NOT IN (SELECT url FROM {f.LINKS_SQL} WHERE page_id % 2 = 1)")
def _(spark, d):
    pages = f.extracted(spark, d)
    return crosspage.link_targets(pages.where("page_id % 2 = 0"), crosspage.link_targets(pages.where("page_id % 2 = 1")))


@register("set_5_crawl_depths", "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS source, l_suppkey + 7 AS target FROM lineitem), r AS (SELECT 1::BIGINT AS url, 0 AS depth UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.url WHERE r.depth < 3) SELECT CAST(url AS VARCHAR) AS url, min(depth) AS depth FROM r GROUP BY url")
def _(spark, d):
    edges = f.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("source"), (F.col("l_suppkey") + 7).cast("string").alias("target")).distinct()
    return crosspage.crawl_depths(edges, spark.range(1).select(F.lit("1").alias("url")))


@register("join_1_with_url", f"SELECT id, url FROM {f.ISSUES_SQL} JOIN {f.PAGE_DIM_SQL} USING (page_id)")
def _(spark, d):
    return reports.with_url(f.issues(spark, d), f.page_dim(spark, d)).select("id", "url")


@register("join_6_explain_issues", f"SELECT id, i.check_id, c.category, CAST(c.weight AS INT) AS weight FROM {f.ISSUES_SQL} i LEFT JOIN {f.CHECKS_SQL} c ON c.check_id = i.check_id")
def _(spark, d):
    return reports.explain_issues(f.issues(spark, d)).select("id", "check_id", "category", "weight")


_GROUPED = f"(SELECT page_id, url, lower(title) AS k, min(title) OVER (PARTITION BY lower(title)) AS sample, count(*) OVER (PARTITION BY lower(title)) AS page_count FROM {f.PAGES_SQL} WHERE title <> '')"


@register("join_7_duplicate_siblings", f"SELECT a.page_id, 'title' AS field, a.sample, a.page_count, string_agg(b.url, '|' ORDER BY b.url) AS urls FROM {_GROUPED} a JOIN {_GROUPED} b ON a.k = b.k AND a.page_id <> b.page_id GROUP BY ALL")
def _(spark, d):
    out = crosspage.duplicate_siblings(f.extracted(spark, d), "title")
    return out.withColumn("urls", F.when(F.size("urls") > 0, F.array_join("urls", "|")))


@register("lim_4_duplicate_groups", f"SELECT 'title' AS field, sample, page_count, string_agg(url, '|' ORDER BY url) AS urls FROM {_GROUPED} WHERE page_count > 1 GROUP BY k, sample, page_count ORDER BY page_count DESC, md5(k) LIMIT 200")
def _(spark, d):
    pages = f.extracted(spark, d).select("page_id", "url", "title", "title_hash")
    return reports.duplicate_groups(crosspage.duplicate_groups(pages, "title"), pages).withColumn("urls", F.array_join("urls", "|"))


_RANKED = f"(SELECT page_id, url, k, page_count, row_number() OVER (PARTITION BY k ORDER BY url, page_id) AS rank FROM {_GROUPED} WHERE page_count > 1)"


def _members(spark, d) -> DataFrame:
    return crosspage.duplicate_members(f.extracted(spark, d).select("page_id", "url", "title", "title_hash"), "title")


@register("agg_1_duplicate_members", f"SELECT page_id, url, page_count FROM {_RANKED}")
def _(spark, d):
    return _members(spark, d).select("page_id", "url", "page_count")


@register("lim_4_group_heads", f"SELECT page_count, string_agg(url, '|' ORDER BY rank) AS urls FROM {_RANKED} WHERE rank <= 3 GROUP BY k, page_count")
def _(spark, d):
    return crosspage.group_heads(_members(spark, d), 3).select("page_count", F.array_join("urls", "|").alias("urls"))


@register("join_7_first_siblings", f"SELECT a.page_id, a.page_count, string_agg(b.url, '|' ORDER BY b.rank) AS urls FROM {_RANKED} a JOIN {_RANKED} b ON a.k = b.k AND a.page_id <> b.page_id AND b.rank <= 3 + CASE WHEN a.rank <= 3 THEN 1 ELSE 0 END GROUP BY ALL")
def _(spark, d):
    return crosspage.first_siblings(_members(spark, d), 3).select("page_id", "page_count", F.array_join("urls", "|").alias("urls"))


_FEED = f"SELECT c.crawl_id, c.status, c.created_at, w.website_name, p.project_name, lower(c.group_id) AS group_name, a.score FROM {f.CRAWLS_SQL} c JOIN {f.WEBSITES_SQL} w USING (website_id) JOIN {f.PROJECTS_SQL} p USING (project_id) LEFT JOIN {f.AGGREGATES_SQL} a ON a.crawl_id = c.crawl_id AND a.crawl_id % 4 <> 0 WHERE p.deleted_at IS NULL"


def _feed(spark, d, **how):
    scored = f.aggregates(spark, d).where("crawl_id % 4 <> 0")
    out = reports.crawl_feed(f.crawls(spark, d), f.websites(spark, d), f.projects(spark, d), f.groups(spark, d), scored, **how)
    return out.select("crawl_id", "status", "created_at", "website_name", "project_name", "group_name", "score")


@register("join_9_crawl_feed", _FEED)
def _(spark, d):
    return _feed(spark, d, limit=None)


@register("join_9_crawl_feed_top", f"{_FEED} AND p.project_id = 5 ORDER BY c.created_at DESC, c.crawl_id DESC LIMIT 50")
def _(spark, d):
    return _feed(spark, d, project=5)


@register("join_10_group_summaries", f"SELECT g.group_id, lower(g.group_id) AS group_name, m.n AS total_urls, c.crawl_id AS last_crawl_id, a.score AS health_score, a.broken_links AS broken_urls, a.critical + a.high AS errors, a.medium AS warnings FROM (SELECT DISTINCT group_id FROM {f.CRAWLS_SQL} WHERE group_id IS NOT NULL) g JOIN (SELECT group_id, count(*) AS n FROM {f.CRAWLS_SQL} GROUP BY 1) m USING (group_id) JOIN (SELECT group_id, arg_max(crawl_id, struct_pack(t := created_at, c := crawl_id)) AS crawl_id FROM {f.CRAWLS_SQL} GROUP BY 1) c USING (group_id) JOIN {f.AGGREGATES_SQL} a USING (crawl_id)")
def _(spark, d):
    by = F.create_map(*(x for k in ("critical", "high", "medium") for x in (F.lit(k), F.col(k))))
    members = f.crawls(spark, d).select(F.col("crawl_id").alias("page_id"), "group_id")
    out = reports.group_summaries(f.groups(spark, d), members, f.crawls(spark, d), f.aggregates(spark, d).select("crawl_id", "score", "broken_links", by.alias("by_severity")))
    return out.select("group_id", "group_name", "total_urls", "last_crawl_id", "health_score", "broken_urls", "errors", "warnings")


# --- history ---


@register("join_11_previous_crawl", f"SELECT a.crawl_id, arg_max(b.crawl_id, struct_pack(t := b.created_at, c := b.crawl_id)) AS previous_id FROM {f.CRAWLS_SQL} a LEFT JOIN {f.CRAWLS_SQL} b ON b.website_id = a.website_id AND b.group_id IS NOT DISTINCT FROM a.group_id AND b.status = 'completed' AND b.created_at < a.created_at GROUP BY 1")
def _(spark, d):
    runs = f.crawls(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return history.previous_crawl(runs).select("crawl_id", "previous_id")


_CRAWL2 = "(SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat(title, ' v2') ELSE title END AS title FROM " + f.PAGES_SQL + " WHERE page_id % 11 <> 0)"


def _two_crawls(spark, d):
    pages = f.extracted(spark, d).select("page_id", "title")
    changed = F.when(F.col("page_id") % 5 == 0, F.concat("title", F.lit(" v2"))).otherwise(F.col("title"))
    return pages.where("page_id % 10 <> 0"), pages.where("page_id % 11 <> 0").withColumn("title", changed)


@register("join_12_carry_forward", f"SELECT b.page_id, b.page_id * 10 AS carried_from, 304 AS http_status, md5(a.title) AS body_hash, 'carried_forward' AS fetch_status FROM {f.PAGES_SQL} a JOIN {_CRAWL2} b USING (page_id) WHERE a.page_id % 10 <> 0 AND a.title = b.title")
def _(spark, d):
    old, new = _two_crawls(spark, d)
    fetches = new.select(F.lit(2).alias("crawl_id"), "page_id", F.lit(False).alias("not_modified"), F.md5("title").alias("body_hash"), F.lit(None).cast("int").alias("http_status"))
    before = old.select("page_id", (F.col("page_id") * 10).alias("snapshot_id"), F.md5("title").alias("body_hash"), F.lit(1.0).alias("score"))
    return history.carry_forward(fetches, before).select("page_id", "carried_from", "http_status", "body_hash", "fetch_status")


@register("join_13_attach_hints", f"SELECT a.page_id, b.etag FROM {f.PAGES_SQL} a LEFT JOIN (SELECT page_id, concat('e', CAST(page_id AS VARCHAR)) AS etag FROM {f.PAGES_SQL} WHERE page_id % 10 <> 0 AND http_status < 400 AND hops = 0) b USING (page_id)")
def _(spark, d):
    snaps = checks.fetch_status(f.fetched(spark, d)).where("page_id % 10 <> 0").select("page_id", "fetch_status", F.col("page_id").alias("snapshot_id"), F.concat(F.lit("e"), F.col("page_id").cast("string")).alias("etag"), F.lit("").alias("last_modified"), F.lit("").alias("body_hash"))
    return history.attach_hints(f.table(spark, d, "pages").select("page_id"), snaps).select("page_id", "etag")


@register("set_6_key_diff", f"SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.page_id IS NULL THEN 'added' WHEN b.page_id IS NULL THEN 'removed' ELSE 'kept' END AS state FROM (SELECT page_id FROM pages WHERE page_id % 10 <> 0) a FULL JOIN (SELECT page_id FROM pages WHERE page_id % 11 <> 0) b ON a.page_id = b.page_id")
def _(spark, d):
    return history.key_diff(*_two_crawls(spark, d), ["page_id"])


@register("diff_1_entity_changes", f"SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'schema_removed' WHEN a.page_id IS NULL THEN 'schema_added' ELSE 'schema_modified' END AS change_type, CASE WHEN b.page_id IS NULL THEN 'high' WHEN a.page_id IS NULL THEN 'info' ELSE 'medium' END AS severity FROM (SELECT page_id, title FROM {f.PAGES_SQL} WHERE page_id % 10 <> 0) a FULL JOIN {_CRAWL2} b ON a.page_id = b.page_id WHERE a.title IS DISTINCT FROM b.title")
def _(spark, d):
    as_entity = lambda frame: frame.select("page_id", F.lit(0).alias("pos"), F.lit("WebPage").alias("type"), F.col("page_id").cast("string").alias("identity"), F.md5("title").alias("entity_hash"))
    return history.entity_changes(*map(as_entity, _two_crawls(spark, d))).select("page_id", "change_type", "severity")


@register("page_changes", f"SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'removed' WHEN a.page_id IS NULL THEN 'added' ELSE 'changed' END AS change, CASE WHEN a.page_id IS NOT NULL AND b.page_id IS NOT NULL THEN a.title END AS before, CASE WHEN a.page_id IS NOT NULL AND b.page_id IS NOT NULL THEN b.title END AS after FROM (SELECT page_id, title FROM {f.PAGES_SQL} WHERE page_id % 10 <> 0) a FULL JOIN {_CRAWL2} b ON a.page_id = b.page_id WHERE a.title IS DISTINCT FROM b.title")
def _(spark, d):
    return history.page_changes(*_two_crawls(spark, d), ["title"]).drop("field")


@register("diff_4_cap_properties", "SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN '{}' ELSE text END AS properties FROM documents")
def _(spark, d):
    return history.cap_properties(f.table(spark, d, "documents").select("doc_id", F.col("text").alias("properties")), 4000)


@register("agg_19_schema_history", f"SELECT crawl_id, score FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY created_at DESC, crawl_id DESC) AS n FROM {f.CRAWLS_SQL}) c JOIN {f.AGGREGATES_SQL} a USING (crawl_id) WHERE n <= 5 AND status = 'completed'")
def _(spark, d):
    return history.schema_history(f.crawls(spark, d), f.aggregates(spark, d), newest=5).select("crawl_id", "score")


@register("win_2_latest_per_group", f"SELECT website_id, arg_max(crawl_id, struct_pack(t := created_at, c := crawl_id)) AS crawl_id FROM {f.CRAWLS_SQL} GROUP BY 1")
def _(spark, d):
    return history.latest_per(f.crawls(spark, d), ["website_id"], "created_at", "crawl_id").select("website_id", "crawl_id")


@register("win_1_first_in_page", f"SELECT page_id, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(text[1]) ORDER BY pos) AS n FROM {f.LINKS_SQL}) WHERE n = 1")
def _(spark, d):
    return crosspage.first_in_page(f.links(spark, d).withColumn("k", F.lower(F.substring("text", 1, 1))), ["page_id", "k"], "pos").select("page_id", "pos", "text")


@register("win_4_previous_level", "SELECT page_id, pos, level, lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS previous FROM (SELECT DISTINCT l_orderkey AS page_id, l_partkey * 10 + l_linenumber AS pos, CAST(l_partkey % 6 + 1 AS INT) AS level FROM lineitem)")
def _(spark, d):
    rows = f.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 6 + 1).cast("int").alias("level")).distinct()
    return crosspage.previous_level(rows)


@register("lim_6_trend", "SELECT o_custkey AS group_id, CAST(o_orderdate AS DATE) AS day, o_orderkey AS score FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' - 30 AND DATE '1998-01-01'")
def _(spark, d):
    daily = f.table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("score"))
    return history.trend(daily, F.lit("1998-01-01").cast("date"))


@register("lim_7_latest", f"SELECT website_id, arg_max(crawl_id, struct_pack(d := status = 'completed', t := created_at, c := crawl_id)) AS crawl_id FROM {f.CRAWLS_SQL} GROUP BY 1")
def _(spark, d):
    return history.latest(f.crawls(spark, d))


@register("lim_8_recent_completed", f"SELECT crawl_id FROM (SELECT crawl_id, row_number() OVER (PARTITION BY website_id ORDER BY created_at DESC, crawl_id DESC) AS n FROM {f.CRAWLS_SQL} WHERE status = 'completed') WHERE n <= 3")
def _(spark, d):
    return history.recent_completed(f.crawls(spark, d), 3).select("crawl_id")


# --- aggregates ---



@register("agg_2_page_scores", f"SELECT page_id, score FROM {_scores_sql(f.ISSUES_SQL, 0)}")
def _(spark, d):
    return scoring.page_scores(f.issues(spark, d))


@register("agg_3_rescore", f"SELECT p_partkey AS page_id, coalesce(s.score, 100.0) AS score FROM part LEFT JOIN {_scores_sql(f.ISSUES_SQL)} s ON s.page_id = p_partkey")
def _(spark, d):
    return scoring.rescore(f.page_dim(spark, d).select("page_id", F.lit(100.0).alias("score")), f.issues(spark, d))


@register("agg_4_issue_counts", f"SELECT page_id, {_COUNTS}, count(*) AS total FROM {f.ISSUES_SQL} GROUP BY page_id")
def _(spark, d):
    counts = scoring.issue_counts(f.issues(spark, d))
    n = lambda k: F.coalesce(F.element_at("issue_counts", F.lit(k)), F.lit(0)).cast("long").alias(k)
    return counts.select("page_id", *map(n, catalog.SEVERITIES), scoring.issue_total(F.col("issue_counts")).cast("long").alias("total"))


@register("agg_6_site_score", f"SELECT round(CASE WHEN avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) > 0.1 THEN least(avg(score), 79) ELSE avg(score) END, 2) AS site_score, count(*) AS scored_pages, count(*) FILTER (WHERE c > 0) AS critical_pages FROM {_scores_sql(f.ISSUES_SQL)} JOIN (SELECT page_id, count(*) FILTER (WHERE severity = 'critical') AS c FROM {f.ISSUES_SQL} GROUP BY 1) USING (page_id)")
def _(spark, d):
    found = f.issues(spark, d)
    pages = scoring.rescore(found.select("page_id").distinct().withColumn("score", F.lit(100.0)), found)
    return scoring.site_score(pages.join(scoring.issue_counts(found), "page_id"))


@register("agg_8_issue_summary", f"SELECT check_id, severity, count(*) AS n FROM {f.ISSUES_SQL} GROUP BY 1, 2")
def _(spark, d):
    return reports.counts_by(f.issues(spark, d), "check_id", "severity")


@register("agg_9_severity_counts", f"SELECT severity, count(*) AS n FROM {f.ISSUES_SQL} GROUP BY 1")
def _(spark, d):
    return reports.counts_by(f.issues(spark, d), "severity")


@register("agg_15_broken_count", f"SELECT count(*) FILTER (WHERE NOT ok) AS broken FROM {f.LINK_CHECKS_SQL}")
def _(spark, d):
    return reports.broken_count(f.link_checks(spark, d))


@register("agg_17_schema_health", "SELECT CAST(round(100 * sum(w) / count(*)) AS INT) AS health FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 0.2 WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.7 END AS w FROM lineitem)")
def _(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "errors").when(F.col("l_returnflag") == "N", "valid").otherwise("warnings")
    return scoring.schema_health(f.table(spark, d, "lineitem").groupBy(status.alias("status")).agg(F.count("*").alias("n")))


@register("category_scores", f"SELECT page_id, category, round(greatest(0, least(100, 100 - sum(weight * (1 + log2(n) * 0.1) * mult))), 2) AS score FROM (SELECT page_id, check_id, severity, count(*) AS n FROM {f.ISSUES_SQL} GROUP BY ALL) JOIN {f.CHECKS_SQL} USING (check_id) JOIN {f.MULTIPLIERS_SQL} USING (severity) GROUP BY 1, 2")
def _(spark, d):
    return scoring.category_scores(f.issues(spark, d))


@register("lim_1_keyset_page", f"SELECT id, created_at FROM {f.ISSUES_SQL} WHERE (created_at, id) > (TIMESTAMP '1995-06-01', 1000) ORDER BY created_at, id LIMIT 100")
def _(spark, d):
    page = reports.keyset_page(f.issues(spark, d), ["created_at", "id"], (F.expr("TIMESTAMP_NTZ '1995-06-01'"), 1000), 100)
    return page.select("id", "created_at")


@register("lim_2_keyset_desc", "SELECT o_orderkey FROM orders WHERE o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 50")
def _(spark, d):
    return reports.keyset_desc(f.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@register("lim_3_page_issues", f"SELECT id, check_id, CAST(rank AS INT) AS rank FROM {f.ISSUES_SQL} JOIN {f.MULTIPLIERS_SQL} USING (severity) WHERE page_id = 17")
def _(spark, d):
    return reports.page_issues(f.issues(spark, d), None, 17).select("id", "check_id", "rank")


@register("lim_5_top_checks", f"SELECT check_id, count(*) AS n FROM {f.ISSUES_SQL} GROUP BY 1 ORDER BY n DESC, check_id LIMIT 10")
def _(spark, d):
    return reports.top_counts(f.issues(spark, d), "check_id")


@register("lim_10_list_dim", f"SELECT website_id, website_name FROM {f.WEBSITES_SQL} WHERE project_id = 3")
def _(spark, d):
    return reports.list_dim(f.websites(spark, d), ["website_name"], project_id=3).select("website_id", "website_name")


# --- progress, over tables ---

_TOTALS = f"(SELECT *, 2 * count(*) OVER (PARTITION BY crawl_id) AS total FROM {f.EVENTS_SQL})"


def _events(spark, d):
    from pyspark.sql.window import Window

    return f.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("total", 2 * F.count("*").over(Window.partitionBy("crawl_id")))


@register("str_1_progress", f"SELECT crawl_id, count(*) FILTER (WHERE outcome = 'crawled') AS crawled, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) AS settled, max(total) AS total, 50 AS percent, arg_max(url, struct_pack(t := ts, u := url)) AS current_url FROM {_TOTALS} GROUP BY 1")
def _(spark, d):
    return progress.progress(_events(spark, d)).drop("elapsed_s", "eta_s")


def _streamed(spark, rows: DataFrame, make) -> DataFrame:
    """``rows`` as a stream through ``make``, to its end; what it told, read again."""
    path = store.scratch(spark, "stream")
    rows.write.parquet(f"{path}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    provider, rocks = progress.ROCKS
    before = spark.conf.get(provider)
    spark.conf.set(provider, rocks)
    try:
        out = make(live)
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@register("str_3_completed", f"SELECT crawl_id, count(*) AS settled, count(*) AS total FROM {f.EVENTS_SQL} WHERE crawl_id % 2 = 0 GROUP BY 1")
def _(spark, d):
    total = F.when(F.col("crawl_id") % 2 == 0, F.col("total") / 2).otherwise(F.col("total")).cast("long")
    return _streamed(spark, _events(spark, d).withColumn("total", total).select("crawl_id", "ts", "total"), progress.completions)


@register("str_4_dedupe", f"SELECT DISTINCT crawl_id, domain FROM {f.EVENTS_SQL}")
def _(spark, d):
    return progress.dedupe(_events(spark, d), ["crawl_id", "domain"]).select("crawl_id", "domain")


@register("str_6_rate_audit", f"SELECT domain, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second, count(*) AS n, greatest(count(*) - 1, 0) AS excess FROM {f.EVENTS_SQL} GROUP BY 1, 2")
def _(spark, d):
    out = progress.rate_audit(_events(spark, d), rate=1)
    return out.select("domain", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("second"), "n", "excess")


#: Whole hours, so that seconds hold many events of a domain.
_SECONDS = f"(SELECT event_id, domain, TIMESTAMP '2024-01-01' + to_microseconds(CAST(epoch_us(ts) % 3600000000 AS BIGINT) // 10) AS ts FROM {f.EVENTS_SQL})"


@register(
    "str_6_waits",
    f"""SELECT event_id, place, CASE WHEN place > 2 THEN CAST(ceil((1000000 - epoch_us(ts) % 1000000) / 1000.0) AS BIGINT) ELSE 0 END AS wait_ms FROM (
  SELECT event_id, ts, row_number() OVER (PARTITION BY domain, epoch_us(ts) // 1000000 ORDER BY ts, event_id) AS place, max(ts) OVER () AS last FROM {_SECONDS}) WHERE (epoch_us(ts) // 1000000 + 11) * 1000000 < epoch_us(last)""",
)
def _(spark, d):
    """The wait of each event at two a second and domain, over a stream, for the seconds that are over when it ends."""
    us = F.lit(1704067200000000) + F.floor(F.unix_micros("ts") % 3600000000 / 10).cast("long")
    rows = _events(spark, d).select("event_id", "domain", F.timestamp_micros(us).alias("ts"))
    return _streamed(spark, rows, lambda live: progress.wait_stream(live, rate=2)).select("event_id", "place", "wait_ms")


_FINISHED = f"(SELECT event_id, crawl_id, ts, event_id % 997 = 5 AS fin FROM {f.EVENTS_SQL})"


@register(
    "str_9_feed_stream",
    f"""WITH e AS (SELECT *, 100 * (crawl_id % 3) + count(*) FILTER (WHERE NOT fin) OVER w AS settled, count(*) FILTER (WHERE fin) OVER w - fin::INT AS over FROM {_FINISHED} WINDOW w AS (PARTITION BY crawl_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT coalesce(event_id, -1) AS event_id, crawl_id, CAST(settled AS BIGINT) AS settled, fin AS finished FROM e WHERE over = 0 UNION ALL SELECT DISTINCT -1, crawl_id, 100 * (crawl_id % 3), false FROM e WHERE crawl_id % 3 > 0""",
)
def _(spark, d):
    """A stream that starts from a stored snapshot of some crawls and ends each crawl with its event ``finished``."""
    events = _events(spark, d).withColumn("outcome", F.when(F.col("event_id") % 997 == 5, "finished").otherwise(F.col("outcome")))
    snapshot = events.where("crawl_id % 3 > 0").select("crawl_id", (100 * (F.col("crawl_id") % 3)).alias("settled"), F.lit(False).alias("finished")).distinct()
    told = _streamed(spark, events.select("crawl_id", "event_id", "ts", "outcome"), lambda live: progress.feed_stream(live, snapshot))
    return told.select(F.coalesce("event_id", F.lit(-1)).alias("event_id"), "crawl_id", "settled", "finished")


@register("str_9_progress_feed", f"SELECT event_id, count(*) OVER (PARTITION BY crawl_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS settled FROM {f.EVENTS_SQL}")
def _(spark, d):
    return progress.progress_feed(_events(spark, d)).select("event_id", "settled")

"""Findings across pages: duplicates, broken links and images, redirect chains, link targets, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import CHECKS
from ..functions import urls
from ..sources.readers import first_per
from ..sources.store import kept

#: field: columns of its hash and its text
FIELDS = {"title": ("title_hash", "title"), "description": ("description_hash", "meta_description"), "h1": ("h1_hash", "h1_text")}


def _hashed(pages: DataFrame, field: str, *more: str) -> DataFrame:
    hash_col, text_col = FIELDS[field]
    return pages.select("page_id", *more, F.col(hash_col).alias("hash"), F.col(text_col).alias("value")).where("hash is not null and coalesce(value, '') <> ''")


def _once(rows: DataFrame) -> DataFrame:
    """Narrow rows of pages that are counted and then met again, written in between, so that no page is read twice."""
    return kept(rows, "values")


def duplicate_groups(pages: DataFrame, field: str) -> DataFrame:
    """(field, hash, value_hash, sample, page_ids, page_count) of values on more than one page."""
    groups = _hashed(pages, field).groupBy("hash").agg(F.min("value").alias("sample"), F.sort_array(F.collect_list("page_id")).alias("page_ids"), F.count("*").alias("page_count"))
    return groups.where("page_count > 1").select(F.lit(field).alias("field"), "hash", F.md5("hash").alias("value_hash"), "sample", "page_ids", "page_count")


def duplicate_members(pages: DataFrame, field: str) -> DataFrame:
    """(field, hash, page_id, url, page_count): a row for each page of a value on more than one page, and no array of all of them."""
    hash_col, text_col = FIELDS[field]
    own = _once(pages.where(F.col(hash_col).isNotNull() & (F.coalesce(F.col(text_col), F.lit("")) != "")).select("page_id", "url", F.col(hash_col).alias("hash")))
    counts = own.groupBy("hash").agg(F.count("*").alias("page_count")).where("page_count > 1")
    return own.join(counts, "hash").select(F.lit(field).alias("field"), "hash", "page_id", "url", "page_count")


def group_heads(members: DataFrame, n: int = 20) -> DataFrame:
    """(field, hash, page_count, urls): the first ``n`` URLs of each group of ``duplicate_members``, ties to the smaller page, and how many
    there are. Every task sends on n rows a group at most, so a value on a million pages is as much work as any."""
    first = Window.partitionBy("field", "hash").orderBy("url", "page_id")
    some = members.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"])
    return some.groupBy("field", "hash", "page_count").agg(listed.alias("urls"))


def first_siblings(members: DataFrame, n: int = 20) -> DataFrame:
    """(page_id, field, page_count, urls): the first ``n`` other pages in each of a page's groups, and how many pages the group has.

    Each page meets one row of its group, n + 1 URLs long; pages of a group are never paired with each other.
    """
    first = Window.partitionBy("field", "hash").orderBy("url", "page_id")
    some = members.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n + 1)
    heads = some.groupBy("field", "hash").agg(F.array_sort(F.collect_list(F.struct("rank", "page_id", "url"))).alias("head"))
    met = members.select("field", "hash", "page_id", "page_count").join(heads, ["field", "hash"])
    others = F.slice(F.filter("head", lambda x: x["page_id"] != F.col("page_id")), 1, n)
    return met.select("page_id", "field", "page_count", F.transform(others, lambda x: x["url"]).alias("urls"))


#: Pages of a group that one row of work lists the others for, and tasks a core that such rows are dealt to: a result grows with the square
#: of a group, so a task is to hold few of its pages.
SHARE, LISTS_A_CORE = 64, 16


def listing() -> list[Column]:
    """Aggregates of a group's pages (page_id, url): own, each id once, and listed, their (url, page_id) sorted."""
    return [F.collect_set("page_id").alias("own"), F.sort_array(F.collect_list(F.when(F.col("page_id").isNotNull(), F.struct("url", "page_id")))).alias("listed")]


def siblings(groups: DataFrame) -> DataFrame:
    """(page_id, field, sample, page_count, urls): the URLs of all other pages of a page's groups, sorted; groups: field, sample, page_count and ``listing``.

    Pages are never paired: a group's list goes once to every ``SHARE`` of its pages, which are dealt over all cores. The longest lists come
    first in a task, since a Parquet writer looks at its memory after as many rows as the lengths so far let it expect: long ones after short
    ones pile up.
    """
    shares = F.transform(F.sequence(F.lit(1), F.size("own"), F.lit(SHARE)), lambda k: F.slice("own", k, SHARE))
    pieces = groups.where(F.size("own") > 1).withColumn("ids", F.size("own")).withColumn("own", F.explode(shares))
    tasks = LISTS_A_CORE * groups.sparkSession.sparkContext.defaultParallelism
    dealt = pieces.repartition(tasks, F.get("own", F.lit(0))).sortWithinPartitions(F.desc("page_count"))
    each = dealt.select(F.explode("own").alias("page_id"), "field", "sample", "page_count", "ids", "listed")
    others = F.transform(F.filter("listed", lambda x: (x["page_id"] != F.col("page_id")) & x["url"].isNotNull()), lambda x: x["url"])
    # a page that is there several times meets the others as often
    times = F.size(F.filter("listed", lambda x: x["page_id"] == F.col("page_id")))
    met = F.when(F.size("listed") == F.col("ids"), others).otherwise(F.flatten(F.transform(others, lambda u: F.array_repeat(u, times))))
    return each.select("page_id", "field", "sample", "page_count", met.alias("urls"))


def duplicate_siblings(pages: DataFrame, field: str) -> DataFrame:
    """``siblings`` of all pages that share a value, read in one pass over ``pages``."""
    groups = _hashed(pages, field, "url").groupBy("hash").agg(F.min("value").alias("sample"), F.count("*").alias("page_count"), *listing())
    return siblings(groups.withColumn("field", F.lit(field)))


def duplicate_issues(pages: DataFrame, field: str, site: str = "1") -> DataFrame:
    """One finding for each page whose value another page has too."""
    check = f"duplicate.{field}"
    own = _once(_hashed(pages, field))
    counts = own.groupBy("hash").agg(F.count("*").alias("duplicate_count")).where("duplicate_count > 1")
    print_ = F.sha2(F.concat_ws(":", F.lit(site), F.col("page_id").cast("string"), F.lit(check)), 256)
    return own.join(counts, "hash").select("page_id", F.lit(check).alias("check_id"), F.lit(CHECKS[check]["severity"]).alias("severity"), "value", "duplicate_count", F.lit(field).alias("field"), print_.alias("fingerprint"))


def _first(pages: DataFrame, items: str, key: str) -> DataFrame:
    """Each page's items, the first one for each key, in page order."""
    rows = pages.select("page_id", F.posexplode(items).alias("pos", "x")).select("page_id", "pos", F.col(f"x.{key}").alias("target"), "x").where("target is not null and target <> ''")
    # the smallest position for each key needs no sort
    return rows.groupBy("page_id", "target").agg(F.min_by("x", "pos").alias("x"))


def _print(kind: str) -> Column:
    return F.sha2(F.concat_ws(":", F.col("page_id").cast("string"), "target", F.lit(kind)), 256).alias("fingerprint")


def _results(link_checks: DataFrame, when: str) -> DataFrame:
    return link_checks.where(when).select(F.col("url").alias("target"), "is_internal", "status", "error", "redirect_hops")


def broken_links(pages: DataFrame, link_checks: DataFrame) -> DataFrame:
    """A finding for each page and target that is not ok; link_checks: url, is_internal, ok, status, error, redirect_hops."""
    met = _first(pages, "links", "href").join(_results(link_checks, "not ok"), "target")
    inside, outside = "links.internal.broken", "links.external.broken"
    pick = lambda what: F.when(F.col("is_internal"), CHECKS[inside][what] if what != "id" else inside).otherwise(CHECKS[outside][what] if what != "id" else outside)
    return met.select("page_id", pick("id").alias("check_id"), pick("severity").alias("severity"), "target", "status", "error", F.col("x.text").alias("anchor"), F.col("x.selector").alias("selector"), F.col("x.snippet").alias("snippet"), _print("broken"))


def broken_images(pages: DataFrame, link_checks: DataFrame) -> DataFrame:
    check = "images.src.broken"
    met = _first(pages, "images", "src").join(_results(link_checks, "not ok"), "target")
    return met.select("page_id", F.lit(check).alias("check_id"), F.lit(CHECKS[check]["severity"]).alias("severity"), "target", "status", "error", F.col("x.alt").alias("alt"), F.col("x.selector").alias("selector"), F.col("x.snippet").alias("snippet"), _print("broken_img"))


def redirect_chains(pages: DataFrame, link_checks: DataFrame, max_hops: int = 2) -> DataFrame:
    check = "links.redirect.chain_too_long"
    met = _first(pages, "links", "href").join(_results(link_checks, f"redirect_hops > {max_hops}"), "target")
    return met.select("page_id", F.lit(check).alias("check_id"), F.lit(CHECKS[check]["severity"]).alias("severity"), "target", F.col("redirect_hops").alias("hops"), F.col("x.text").alias("anchor"), F.col("x.selector").alias("selector"), F.col("x.snippet").alias("snippet"), _print("redirect"))


def classify_links(results: DataFrame, websites: DataFrame) -> DataFrame:
    """Probe results (website_id, url, status, redirect_hops) with ok, is_internal and retry_with_get."""
    sites = websites.select("website_id", urls.registrable_domain(urls.host("origin")).alias("site_domain"))
    own = urls.registrable_domain(urls.host("url"))
    return results.join(sites, "website_id").select("website_id", "url", "status", F.coalesce(F.col("status").between(200, 399), F.lit(False)).alias("ok"), F.coalesce(own == F.col("site_domain"), F.lit(False)).alias("is_internal"), F.coalesce("redirect_hops", F.lit(0)).alias("redirect_hops"), F.coalesce(F.col("status").isin(405, 501, 0), F.lit(True)).alias("retry_with_get"))


def link_targets(pages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Distinct targets of links and images, without those ``seen`` (url)."""
    both = F.array_union(F.transform("links", lambda x: x["href"]), F.filter(F.transform("images", lambda x: x["src"]), lambda s: s != ""))
    targets = pages.select(F.explode(both).alias("url")).distinct()
    return targets if seen is None else targets.join(seen.select("url"), "url", "left_anti")


def crawl_depths(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, depth) of all URLs within ``max_depth`` links of a seed; edges: source, target (both normalised).

    One join and one anti-join for each level; each level is written to the checkpoint folder.
    """
    reached = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for depth in range(1, max_depth + 1):
        onward = edges.join(frontier.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        frontier = onward.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        if edges.sparkSession.sparkContext.getCheckpointDir():
            frontier = frontier.checkpoint()
        reached = reached.unionByName(frontier)
    return reached


def orphans(listed: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages of a sitemap (url) that no page links to."""
    return listed.select("url").distinct().join(edges.select(F.col("target").alias("url")), "url", "left_anti")


def first_in_page(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_per(rows, keys, order)


def previous_level(headings: DataFrame) -> DataFrame:
    """(page_id, pos, level, previous) of exploded headings."""
    from pyspark.sql.window import Window

    return headings.withColumn("previous", F.lag("level").over(Window.partitionBy("page_id").orderBy("pos")))


def hreflang_without_return(pages: DataFrame) -> DataFrame:
    """(url, href): alternates of crawled pages (final_url, hreflang) whose own alternates don't lead back."""
    edges = pages.select(F.col("final_url").alias("url"), F.explode("hreflang").alias("x")).select("url", F.col("x.href").alias("href")).where("url <> href").distinct()
    known = edges.join(pages.select(F.col("final_url").alias("href")).distinct(), "href", "left_semi")
    back = edges.select(F.col("href").alias("url"), F.col("url").alias("href"))
    return known.join(back, ["url", "href"], "left_anti").select("url", "href")


def listed_but_noindex(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """URLs of a sitemap (url) whose page asks not to be indexed."""
    barred = pages.where("robots.noindex or robots.header_noindex").select("url")
    return listed.select("url").distinct().join(barred, "url", "left_semi")


def canonical_to_error(pages: DataFrame) -> DataFrame:
    """(url, canonical, http_status): canonicals of crawled pages that lead to a page with an error status."""
    bad = pages.where("http_status >= 400").select(F.col("final_url").alias("canonical"), "http_status")
    return pages.select("url", F.explode("canonicals").alias("canonical")).join(bad, "canonical").select("url", "canonical", "http_status")

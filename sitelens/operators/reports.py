"""Read models: filtered, joined and paged views of crawls, pages, findings, entities and changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import catalog
from ..sources.readers import first_per
from . import crosspage

ACTIVE = ["queued", "running", "paused", "finalizing"]
MAX_PAGE = 200


def after(keys: Sequence[str], values: Sequence) -> Column:
    """Row-value comparison (k1, k2, ...) > (v1, v2, ...), which scans can use for its first key."""
    steps = []
    for k in range(len(keys)):
        same = [F.col(keys[i]) == F.lit(values[i]) for i in range(k)]
        steps.append(reduce(lambda a, b: a & b, [*same, F.col(keys[k]) > F.lit(values[k])]))
    return (F.col(keys[0]) >= F.lit(values[0])) & reduce(lambda a, b: a | b, steps)


def keyset_page(frame: DataFrame, keys: Sequence[str], cursor: Sequence | None = None, limit: int = 50) -> DataFrame:
    """The next ``limit`` rows past the cursor in key order, with has_more."""
    limit = max(1, min(MAX_PAGE, limit))
    rows = frame if cursor is None else frame.where(after(keys, cursor))
    page = rows.orderBy(*keys).limit(limit + 1)
    order = Window.orderBy(*keys)
    return page.withColumn("__n", F.row_number().over(order)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(f"__n <= {limit}").drop("__n")


def next_cursor(page: DataFrame, keys: Sequence[str]) -> tuple | None:
    last = page.where("has_more").orderBy(*(F.desc(k) for k in keys)).select(*keys).first()
    return None if last is None else tuple(last)


def keyset_desc(frame: DataFrame, column: str, before=None, limit: int = 50) -> DataFrame:
    rows = frame if before is None else frame.where(F.col(column) < F.lit(before))
    return rows.orderBy(F.desc(column)).limit(limit)


def with_url(facts: DataFrame, pages: DataFrame) -> DataFrame:
    return facts.join(pages.select("page_id", "url"), "page_id")


def where_all(frame: DataFrame, **conditions) -> DataFrame:
    """Equality filters; a list means any of its values, None means no filter."""
    for name, value in conditions.items():
        if value is not None:
            frame = frame.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return frame


def issues(facts: DataFrame, pages: DataFrame, crawl, severity=None, check_id=None, cursor=None, limit: int = 50) -> DataFrame:
    return keyset_page(with_url(where_all(facts, crawl_id=crawl, severity=severity, check_id=check_id), pages), ["created_at", "id"], cursor, limit)


def snapshots(facts: DataFrame, pages: DataFrame, crawl, fetch_status=None, cursor=None, limit: int = 50) -> DataFrame:
    return keyset_page(with_url(where_all(facts, crawl_id=crawl, fetch_status=fetch_status), pages), ["created_at", "id"], cursor, limit)


def entities(facts: DataFrame, pages: DataFrame, crawl, schema_type=None, status=None, format=None, cursor=None, limit: int = 50) -> DataFrame:
    return keyset_page(with_url(where_all(facts, crawl_id=crawl, type=schema_type, status=status, format=format), pages), ["created_at", "id"], cursor, limit)


def changes(facts: DataFrame, pages: DataFrame, crawl, change_type=None, severity=None, cursor=None, limit: int = 50) -> DataFrame:
    own = where_all(facts, crawl_id=crawl, change_type=change_type, severity=severity)
    return keyset_page(own.join(pages.select("page_id", "url"), "page_id", "left"), ["created_at", "id"], cursor, limit)


def failed_pages(facts: DataFrame, pages: DataFrame, crawl=None) -> DataFrame:
    return with_url(where_all(facts, crawl_id=crawl, fetch_status="error"), pages)


def stuck_crawls(crawls: DataFrame, stale_before) -> DataFrame:
    """Unfinished crawls from before a time that are finalizing, or running with every page settled."""
    n = lambda k: F.coalesce(F.element_at("stats", F.lit(k)), F.lit(0))
    settled = (n("total") > 0) & (n("crawled") + n("unchanged") + n("failed") >= n("total"))
    return crawls.where(F.col("finished_at").isNull() & (F.col("created_at") < F.lit(stale_before)) & ((F.col("status") == "finalizing") | (F.col("status") == "running") & settled)).orderBy("created_at")


def active_conflicts(crawls: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, crawl_id): the newest active crawl that a request (request_id, website_id, group_id) would overlap.

    A group's crawl conflicts with that group and with crawls of the whole site; a site's with all.
    """
    active = crawls.where(F.col("status").isin(*ACTIVE)).select("website_id", F.col("group_id").alias("g"), F.struct("created_at", "crawl_id").alias("c"))
    # the newest of each group, of those of the whole site, and of all; so a request meets one row of each
    newest = active.groupBy("website_id", "g").agg(F.max("c").alias("c"))
    own = newest.where("g is not null").select("website_id", F.col("g").alias("group_id"), F.col("c").alias("own"))
    site = newest.groupBy("website_id").agg(F.max(F.when(F.col("g").isNull(), F.col("c"))).alias("site"), F.max("c").alias("any"))
    met = requests.join(site, "website_id").join(own, ["website_id", "group_id"], "left")
    best = F.when(F.col("group_id").isNull(), F.col("any")).otherwise(F.greatest("site", "own"))
    return met.groupBy("request_id").agg(F.max(best)["crawl_id"].alias("crawl_id")).where("crawl_id is not null")


def visible_projects(projects: DataFrame, members: DataFrame, user) -> DataFrame:
    own = members.where(F.col("user_id") == user).select("project_id")
    return projects.where("deleted_at is null").join(own, "project_id", "left_semi")


def explain_issues(facts: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Findings with the catalog's name, category, weight and advice; unknown checks keep nulls."""
    checks = catalog.as_df(facts.sparkSession) if checks is None else checks
    return facts.join(F.broadcast(checks.select("check_id", "name", "category", "weight", "suggested_fix")), "check_id", "left")


def rank_of(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, catalog.SEVERITIES)), severity), F.lit(0)), F.lit(5)).cast("int")


def page_issues(facts: DataFrame, crawl, page) -> DataFrame:
    return where_all(facts, crawl_id=crawl, page_id=page).withColumn("rank", rank_of(F.col("severity"))).orderBy("rank", "check_id")


def duplicate_siblings(groups: DataFrame, pages: DataFrame, page_id=None) -> DataFrame:
    """(page_id, field, sample, page_count, urls): the other pages in each of a page's groups, of all pages if none is named."""
    own = groups if page_id is None else groups.where(F.array_contains("page_ids", page_id))
    members = own.select("field", "hash", "sample", "page_count", F.explode(F.array_distinct("page_ids")).alias("page_id")).join(pages.select("page_id", "url"), "page_id")
    out = crosspage.siblings(members.groupBy("field", "hash", "sample", "page_count").agg(*crosspage.listing()))
    return out if page_id is None else out.where(F.col("page_id") == page_id)


def duplicate_groups(groups: DataFrame, pages: DataFrame, field: str | None = None, limit: int = 200) -> DataFrame:
    """The largest groups with the URLs in them."""
    top = where_all(groups, field=field).orderBy(F.desc("page_count"), "field", "hash").limit(limit)
    members = top.select("field", "hash", "sample", "page_count", F.explode("page_ids").alias("page_id")).join(pages.select("page_id", "url"), "page_id")
    return members.groupBy("field", "hash", "sample", "page_count").agg(F.sort_array(F.collect_list("url")).alias("urls")).drop("hash")


def page_report(facts: DataFrame, groups: DataFrame, pages: DataFrame, crawl, page) -> DataFrame:
    """A page's findings, explained, a duplicate one with the URLs that it collides with."""
    siblings = duplicate_siblings(groups, pages, page).select(F.concat(F.lit("duplicate."), "field").alias("check_id"), "urls")
    return explain_issues(page_issues(facts, crawl, page)).join(siblings, "check_id", "left")


def crawl_feed(crawls: DataFrame, websites: DataFrame, projects: DataFrame, groups: DataFrame, aggregates: DataFrame, project=None, before=None, limit: int | None = 50) -> DataFrame:
    """Crawls of projects that are not deleted, newest first, with names and the score if there is one."""
    own = projects.where("deleted_at is null").select("project_id", "project_name")
    if project is not None:
        own = own.where(F.col("project_id") == project)
    rows = crawls if before is None else crawls.where(F.col("created_at") < F.lit(before))
    rows = rows.join(websites.select("website_id", "website_name", "project_id"), "website_id").join(own, "project_id")
    rows = rows.join(groups.select("group_id", "group_name"), "group_id", "left").join(aggregates.select("crawl_id", "score"), "crawl_id", "left")
    return rows if limit is None else rows.orderBy(F.desc("created_at"), F.desc("crawl_id")).limit(limit)


def group_summaries(groups: DataFrame, members: DataFrame, crawls: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Each group with its page count, latest crawl, score, broken links, errors and warnings.

    aggregates: crawl_id, score, broken_links, by_severity (a map).
    """
    counts = members.groupBy("group_id").agg(F.count("*").alias("total_urls"))
    latest = first_per(crawls.where("group_id is not null"), ["group_id"], F.desc("created_at"), F.desc("crawl_id")).select("group_id", "crawl_id", "status", "created_at")
    n = lambda *names: reduce(lambda a, b: a + b, (F.coalesce(F.element_at("by_severity", F.lit(k)), F.lit(0)) for k in names))
    joined = groups.join(counts, "group_id", "left").join(latest, "group_id", "left").join(aggregates, "crawl_id", "left")
    return joined.select("group_id", "group_name", F.coalesce("total_urls", F.lit(0)).alias("total_urls"), F.col("crawl_id").alias("last_crawl_id"), F.col("status").alias("last_status"), F.col("created_at").alias("last_crawl_at"), F.col("score").alias("health_score"), F.coalesce("broken_links", F.lit(0)).alias("broken_urls"), n("critical", "high").alias("errors"), n("medium", "low", "info").alias("warnings"))


def counts_by(frame: DataFrame, *keys: str) -> DataFrame:
    """Counts by keys: findings by check and severity, entities by type or status, changes by type."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n"))


def top_counts(frame: DataFrame, key: str, n: int = 10) -> DataFrame:
    return counts_by(frame, key).orderBy(F.desc("n"), key).limit(n)


def coverage(entities_: DataFrame) -> DataFrame:
    """One row: entities, distinct pages, entities eligible for a rich result; rich: array<struct<profile, status>>."""
    eligible = F.exists("rich", lambda r: r["status"].isin("eligible", "eligible_with_warnings"))
    return entities_.agg(F.count("*").alias("entities"), F.count_distinct("page_id").alias("pages"), F.count_if(F.coalesce(eligible, F.lit(False))).alias("rich_eligible"))


def rich_rollup(entities_: DataFrame) -> DataFrame:
    return entities_.select(F.explode("rich").alias("r")).groupBy(F.col("r.profile").alias("profile"), F.col("r.status").alias("status")).agg(F.count("*").alias("n"))


def pages_without_schema(scored: Column, with_schema: Column) -> Column:
    return F.greatest(F.lit(0), scored - with_schema)


def broken_count(link_checks: DataFrame) -> DataFrame:
    return link_checks.agg(F.count_if(~F.col("ok")).alias("broken"))


def list_dim(frame: DataFrame, order: Sequence, **conditions) -> DataFrame:
    return where_all(frame, **conditions).orderBy(*order)

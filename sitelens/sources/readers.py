"""Scans: fetched pages, URL lists, CSV files and their quality gate, discovery seeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls

#: Columns of a fetched page and their types; a source that lacks one gets the default.
PAGE_COLUMNS = {
    "page_id": "bigint",
    "url": "string",
    "final_url": "string",
    "http_status": "int",
    "rendered": "boolean",
    "redirect_chain": "array<struct<url: string, status: int>>",
    "headers": "map<string,string>",
    "html": "string",
    "error": "string",
    "not_modified": "boolean",
    "fetched_at": "timestamp",
}
MAX_INVALID_SHARE, SAMPLES, SAMPLE_CHARS = 0.05, 5, 200


def as_pages(frame: DataFrame) -> DataFrame:
    """The contract of all page operators: every column of PAGE_COLUMNS, in order. Errors are data."""
    defaults = {"final_url": F.col("url"), "http_status": F.lit(200), "rendered": F.lit(False), "not_modified": F.lit(False), "redirect_chain": F.array(), "headers": F.create_map()}
    return frame.select(*((F.col(n) if n in frame.columns else defaults.get(n, F.lit(None))).cast(t).alias(n) for n, t in PAGE_COLUMNS.items()))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return as_pages(spark.read.parquet(path))


def manual_urls(urls_frame: DataFrame, column: str = "url") -> DataFrame:
    """Trimmed, distinct, without blanks; (url, valid)."""
    plain = urls_frame.select(F.trim(column).alias("url")).where("url <> ''").dropDuplicates(["url"])
    return plain.withColumn("valid", urls.is_http("url"))


def first_invalid(frame: DataFrame, n: int = SAMPLES) -> DataFrame:
    return manual_urls(frame).where("not valid").select("url").orderBy("url").limit(n)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    frame = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return frame.toDF(*(c.lstrip("\ufeff").strip() for c in frame.columns))


def csv_urls(spark: SparkSession, path: str, url_column: str) -> DataFrame:
    """URLs of a CSV file with a header row; ragged rows, quoted line breaks and a byte order mark are borne."""
    plain = _csv(spark, path)
    if url_column not in plain.columns:
        raise ValueError(f"column {url_column} not found; the file has {', '.join(plain.columns)}")
    return plain.select(F.trim(F.col(f"`{url_column}`")).alias("url")).where("url <> ''")


#: Fixed value: bytes at the start of an upload that are searched for NUL.
HEAD_BYTES = 8192


def gate_csv_file(spark: SparkSession, path: str, url_column: str = "url") -> DataFrame:
    """One row for an uploaded file: row_count, valid_count, invalid_samples, accepted, reason.

    A file without bytes, with NUL among its first bytes or without the column is turned away by its head alone, before
    any row is read as CSV: reason ``empty file``, ``binary content`` or ``no column``, with no counts. Its rows are judged by
    ``validate_csv_urls``, where a missing or blank cell is an invalid URL. Blank lines are no rows.
    """
    size, head = F.sum("length").alias("bytes"), F.max(F.contains(F.substring("content", 1, HEAD_BYTES), F.lit(b"\0"))).alias("binary")
    found = spark.read.format("binaryFile").load(path).where("length > 0").agg(size, head).first()
    reason = "empty file" if not found.bytes else "binary content" if found.binary else None
    if reason is None:
        frame = _csv(spark, path)
        if url_column in frame.columns:
            return validate_csv_urls(frame.select(F.col(f"`{url_column}`").alias("url")))
        reason = "no column"
    none = F.lit(None).cast("long")
    row = spark.range(1).select(none.alias("row_count"), none.alias("valid_count"), F.array().cast("array<string>").alias("invalid_samples"))
    return row.withColumn("reason", F.lit(reason)).withColumn("accepted", F.lit(False))


def validate_csv_urls(frame: DataFrame, url_column: str = "url") -> DataFrame:
    """One row: row_count, valid_count, invalid_samples (the first few in order), accepted, reason."""
    url = F.trim(F.col(url_column))
    valid = urls.is_http(url)
    counts = frame.agg(F.count("*").alias("row_count"), F.count_if(valid).alias("valid_count"), F.count_if(F.coalesce(url.contains("\0"), F.lit(False))).alias("binary"))
    some = frame.where(~valid).select(F.substring(F.coalesce(url, F.lit("")), 1, SAMPLE_CHARS).alias("u")).distinct().orderBy("u").limit(SAMPLES)
    counts = counts.join(some.agg(F.sort_array(F.collect_list("u")).alias("invalid_samples")))  # one row each
    share = (F.col("row_count") - F.col("valid_count")) / F.col("row_count")
    reason = F.when(F.col("row_count") == 0, "no rows").when(F.col("binary") > 0, "binary content").when(F.col("valid_count") == 0, "no valid URL").when(share > MAX_INVALID_SHARE, "too many invalid URLs")
    return counts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("binary")


def discovery_seeds(frame: DataFrame, origin: str, column: str = "url") -> DataFrame:
    """Start URLs on the site's own origin; they allow discovery."""
    return frame.select(F.trim(column).alias("url")).where(urls.same_origin("url", F.lit(origin))).dropDuplicates(["url"]).withColumn("allow_discovery", F.lit(True))


def parse_lastmod(column: Column) -> Column:
    return F.try_to_timestamp(column)


def resolve_seeds(frames: Sequence[DataFrame], origin: str | None = None) -> DataFrame:
    """(url, allow_discovery, lastmod, source_no): each URL once, of the first source that has it.

    A frame has url and may have allow_discovery and lastmod. Discovery is allowed if any source of
    the URL allows it. Without any URL, ``origin`` stands in.
    """
    parts = []
    for number, frame in enumerate(frames):
        allow = F.col("allow_discovery") if "allow_discovery" in frame.columns else F.lit(False)
        lastmod = F.col("lastmod").cast("string") if "lastmod" in frame.columns else F.lit(None).cast("string")
        parts.append(frame.select(urls.normalize("url").alias("url"), allow.alias("allow_discovery"), lastmod.alias("lastmod"), F.lit(number).alias("source_no")))
    merged = reduce(DataFrame.unionByName, parts).where("url is not null").groupBy("url")
    seeds = merged.agg(F.max("allow_discovery").alias("allow_discovery"), F.min_by("lastmod", "source_no").alias("lastmod"), F.min("source_no").alias("source_no"))
    if origin is None:
        return seeds
    spare = seeds.sparkSession.createDataFrame([(origin,)], "url string").select(urls.normalize("url").alias("url"), F.lit(True).alias("allow_discovery"), F.lit(None).cast("string").alias("lastmod"), F.lit(-1).alias("source_no"))
    some = seeds.limit(1).agg(F.count("*").alias("n"))
    return seeds.unionByName(spare.join(F.broadcast(some)).where("n = 0").drop("n"))


def seeds_for_crawls(crawls: DataFrame, groups: DataFrame, sources: DataFrame) -> DataFrame:
    """(crawl_id, url, allow_discovery): a page crawl has its URL, a group crawl its sitemap's entries, a site crawl all sources.

    crawls: crawl_id, website_id, scope, target_url, group_id; groups: group_id, url; sources: website_id, url, allow_discovery.
    """
    page = crawls.where("scope = 'page'").select("crawl_id", F.col("target_url").alias("url"), F.lit(False).alias("allow_discovery"))
    group = crawls.where("scope = 'group'").join(groups, "group_id").select("crawl_id", "url", F.lit(False).alias("allow_discovery"))
    site = crawls.where("scope = 'site'").join(sources, "website_id").select("crawl_id", "url", "allow_discovery")
    return page.unionByName(group).unionByName(site).groupBy("crawl_id", "url").agg(F.max("allow_discovery").alias("allow_discovery"))


def scope_class(url: str, origin: str, path_scope: str | None = None, allow: Sequence[str] = (), block: Sequence[str] = ()) -> Column:
    """in_scope, out_of_scope or blocked; out of scope outranks blocked, and blocked outranks allowed."""
    path = urls.path_of(url)
    inside = urls.is_http(url) & (urls.registrable_domain(urls.host(url)) == urls.domain_of_url(origin))
    if path_scope:
        scope = path_scope if path_scope.startswith("/") else f"/{path_scope}"
        inside &= (path == scope.rstrip("/")) | path.startswith(scope if scope.endswith("/") else f"{scope}/")
    blocked = reduce(lambda a, g: a | path.rlike(glob(g)), block, F.lit(False))
    if allow:
        blocked |= ~reduce(lambda a, g: a | path.rlike(glob(g)), allow, F.lit(False))
    return F.when(~F.coalesce(inside, F.lit(False)), "out_of_scope").when(blocked, "blocked").otherwise("in_scope")


def glob(pattern: str) -> str:
    """Regular expression of a path glob: ** any characters, * any within a segment, ? one within a segment."""
    import re

    rooted = pattern if pattern[:1] in ("/", "*", "?") else f"/{pattern}"
    return "^" + "".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.findall(r"\*\*|\*|\?|[^*?]+", rooted)) + "$"


def first_per(frame: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return frame.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")



"""Idempotent writes on plain Parquet: replacement, insert-if-absent, upserts, archives, cascades."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versioned
from .readers import first_per


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which executors and driver share; where that is unset, a local one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder, and executors on other machines need a shared one")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to a new scratch folder and read from there: for what several steps read and is dear to make again."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def replace_snapshots(snapshots: DataFrame, issues: DataFrame, entities: DataFrame, path: str, write: str | None = None) -> int:
    """Replace the (crawl_id, page_id) of ``snapshots``, with their issues and entities, in one step; read by ``facts``.

    Other pages of the crawl stay. Issues and entities of a page that has none any more go. Returns the version; a ``write``
    of a name that was committed before is left out, so a batch that runs again changes nothing.
    """
    return versioned.replace(path, {"snapshots": snapshots, "issues": issues, "entities": entities}, snapshots.select("crawl_id", "page_id"), write)


def facts(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The current snapshots, issues or entities; None before the first write."""
    return versioned.read(spark, path, name)


def replaced(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("crawl_id", "page_id")) -> DataFrame:
    """``existing`` without the keys that ``new`` holds, and ``new``."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


#: Folders of change records; one for each crawl would grow with the number of crawls.
CHANGE_BUCKETS = 32


def append_changes(frame: DataFrame, path: str) -> None:
    """Append change records in bulk, below ``crawl_bucket=N``, a hash of the crawl."""
    rows = frame.withColumn("crawl_bucket", F.pmod(F.xxhash64("crawl_id"), F.lit(CHANGE_BUCKETS)).cast("int"))
    rows.hint("rebalance", F.col("crawl_bucket")).write.mode("append").partitionBy("crawl_bucket").parquet(path)


def upsert_catalog(rows: DataFrame, path: str, key: str = "check_id") -> None:
    """The catalog as a table at ``path``: ``rows`` replace those of their id, others stay; read by ``facts(..., "catalog")``."""
    versioned.replace(path, {"catalog": rows}, rows.select(key))


def insert_link_checks(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("crawl_id", "url")) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks, one for each key."""
    return existing.unionByName(new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti"))


def upsert_pages(pages: DataFrame, seen: DataFrame, keys: Sequence[str] = ("website_id", "url")) -> DataFrame:
    """The registry (keys, first_seen, last_seen, is_deleted) after pages (keys, seen_at) were seen again."""
    new = seen.groupBy(*keys).agg(F.min("seen_at").alias("__first"), F.max("seen_at").alias("__last"))
    both = pages.join(new, list(keys), "full_outer")
    return both.select(*keys, F.coalesce("first_seen", "__first").alias("first_seen"), F.greatest("last_seen", "__last").alias("last_seen"), (F.col("__last").isNull() & F.coalesce("is_deleted", F.lit(False))).alias("is_deleted"))


def upsert_latest(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the one that comes first in ``order`` (such as the newest)."""
    return first_per(existing.unionByName(new), keys, *order)


def link_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Membership (page_id, group_id) with the newest lastmod given; rows without one don't replace it."""
    return existing.unionByName(new).groupBy("page_id", "group_id").agg(F.max("lastmod").alias("lastmod"))


def remove_group(tables: Mapping[str, DataFrame], group_id, crawls: str = "crawls") -> dict[str, DataFrame]:
    """All tables without the rows of a group's crawls; tables without crawl_id stay as they are."""
    gone = tables[crawls].where(F.col("group_id") == group_id).select("crawl_id").distinct()
    return {name: frame.join(gone, "crawl_id", "left_anti") if "crawl_id" in frame.columns else frame for name, frame in tables.items()}


def archive_bodies(pages: DataFrame, body: str = "html") -> DataFrame:
    """(key, content_hash, body): each distinct body once, under a key made from its hash."""
    rows = pages.where(F.col(body).isNotNull()).select(F.sha2(body, 256).alias("content_hash"), F.col(body).alias("body"))
    distinct = rows.groupBy("content_hash").agg(F.first("body").alias("body"))
    return distinct.select(F.concat(F.lit("raw/"), F.substring("content_hash", 1, 2), F.lit("/"), "content_hash", F.lit(".html")).alias("key"), "content_hash", "body")


def guarded(column: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(column.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), column)).otherwise(column)


def to_csv(frame: DataFrame, columns: Sequence[str], path: str) -> None:
    frame.select(*(guarded(F.col(c).cast("string")).alias(c) for c in columns)).write.option("header", True).option("escape", '"').csv(path)


def to_json(frame: DataFrame, path: str) -> None:
    frame.write.json(path)

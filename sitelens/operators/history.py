"""Crawls over time: predecessors, latest rows, trends, incremental carry-forward, changes between crawls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import first_per

UNCHANGED = ["ok", "unchanged", "carried_forward"]
MAX_PROPERTIES = 262_144


def previous_crawl(crawls: DataFrame, same_scope: bool = False) -> DataFrame:
    """``crawls`` with previous_id: the newest completed crawl of the same site and group before each one.

    One window for all crawls. Rows of one moment don't precede each other. With ``same_scope``
    the scope has to be equal too.
    """
    keys = ["website_id", "group_id", *(["scope"] if same_scope else [])]
    done = F.when(F.col("status") == "completed", F.struct("created_at", "crawl_id"))
    earlier = Window.partitionBy(*keys).orderBy(F.unix_micros("created_at")).rangeBetween(Window.unboundedPreceding, -1)
    return crawls.withColumn("previous_id", F.max(done).over(earlier)["crawl_id"])


def latest_per(frame: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    return first_per(frame, keys, F.desc(order), F.desc(tie))


def latest(crawls: DataFrame) -> DataFrame:
    """(website_id, crawl_id): the newest completed crawl, else the newest."""
    newest = F.max_by("crawl_id", F.struct((F.col("status") == "completed").alias("done"), "created_at", "crawl_id"))
    return crawls.groupBy("website_id").agg(newest.alias("crawl_id"))


def recent_completed(crawls: DataFrame, n: int = 20) -> DataFrame:
    """The last n completed crawls of each site, in order of time."""
    order = Window.partitionBy("website_id").orderBy(F.desc("created_at"), F.desc("crawl_id"))
    return crawls.where("status = 'completed'").withColumn("__n", F.row_number().over(order)).where(f"__n <= {n}").drop("__n")


def schema_history(crawls: DataFrame, aggregates: DataFrame, website=None, newest: int = 30) -> DataFrame:
    """Metrics of the completed ones among each site's newest crawls; the limit comes first."""
    rows = crawls if website is None else crawls.where(F.col("website_id") == website)
    order = Window.partitionBy("website_id").orderBy(F.desc("created_at"), F.desc("crawl_id"))
    top = rows.withColumn("__n", F.row_number().over(order)).where(f"__n <= {newest}").drop("__n").where("status = 'completed'")
    return top.join(aggregates, "crawl_id", "left")


def trend(daily: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Rows (group_id, day, score) of the last days."""
    return daily.where((F.col("day") >= F.date_sub(as_of, days)) & (F.col("day") <= as_of)).orderBy("group_id", "day")


def trend_by(daily: DataFrame, unit: str, keys: Sequence[str]) -> DataFrame:
    """The last score in each day, week or month."""
    period = F.date_trunc(unit, "day").cast("date").alias("period")
    return daily.groupBy(*keys, period).agg(F.max_by("score", "day").alias("score"))


def hints(snapshots: DataFrame) -> DataFrame:
    """What a conditional request of the next crawl can use."""
    return snapshots.where(F.col("fetch_status").isin(*UNCHANGED)).select("page_id", F.col("snapshot_id"), "etag", "last_modified", "body_hash")


def attach_hints(urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    return urls.join(hints(snapshots), "page_id", "left")


def carry_forward(fetches: DataFrame, previous: DataFrame) -> DataFrame:
    """Snapshots of this crawl for pages that did not change: the previous ones under the new crawl's id.

    fetches: crawl_id, page_id, not_modified, body_hash, http_status; previous: page_id, snapshot_id, body_hash, score, ...
    """
    old = previous.select("page_id", "snapshot_id", F.col("body_hash").alias("old_hash"), "score")
    same = F.coalesce("not_modified", F.lit(False)) | (F.col("body_hash") == F.col("old_hash"))
    met = fetches.join(old, "page_id").where(same)
    return met.select("crawl_id", "page_id", F.col("snapshot_id").alias("carried_from"), F.coalesce("http_status", F.lit(304)).alias("http_status"), F.col("old_hash").alias("body_hash"), "score", F.lit("carried_forward").alias("fetch_status"))


def carry_children(carried: DataFrame, children: DataFrame) -> DataFrame:
    """Findings or entities (page_id, crawl_id, ...) of carried pages, under the new crawl's id.

    Where ``carried`` has previous_crawl_id, only children of that crawl are carried; else all of ``children``.
    """
    if "previous_crawl_id" not in carried.columns:
        return children.drop("crawl_id").join(carried.select("page_id", "crawl_id"), "page_id")
    old = children.withColumnRenamed("crawl_id", "previous_crawl_id")
    return old.join(carried.select("page_id", "previous_crawl_id", "crawl_id"), ["page_id", "previous_crawl_id"]).drop("previous_crawl_id")


def page_changes(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(page_id, change, field, before, after): pages added and removed, and fields that changed."""
    a = before.select("page_id", F.lit(True).alias("in_a"), *(F.col(f).cast("string").alias(f"a_{f}") for f in fields))
    b = after.select("page_id", F.lit(True).alias("in_b"), *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    both = a.join(b, "page_id", "full_outer")
    none = F.lit(None).cast("string")
    row = lambda change, field, x, y: F.struct(F.lit(change).alias("change"), F.lit(field).cast("string").alias("field"), x.alias("before"), y.alias("after"))
    found = [F.when(F.col("in_a").isNull(), row("added", None, none, none)), F.when(F.col("in_b").isNull(), row("removed", None, none, none))]
    found += [F.when(F.col("in_a") & F.col("in_b") & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), row("changed", f, F.col(f"a_{f}"), F.col(f"b_{f}"))) for f in fields]
    return both.select("page_id", F.explode(F.array_compact(F.array(*found))).alias("c")).select("page_id", "c.*")


def issue_changes(before: DataFrame, after: DataFrame, key: str = "fingerprint") -> DataFrame:
    """(fingerprint, state): findings introduced and resolved between two crawls."""
    new = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("state", F.lit("introduced"))
    gone = before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("state", F.lit("resolved"))
    return new.unionByName(gone)


def key_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either side with their state: added, removed or kept."""
    a = before.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = after.select(*keys).distinct().withColumn("__b", F.lit(True))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("kept")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))


def _keyed(entities: DataFrame) -> DataFrame:
    """Entities with their key; of a page's entities with one key the first counts."""
    key = F.concat(F.col("type"), F.lit("::"), F.when(F.coalesce("identity", F.lit("")) != "", F.col("identity")).otherwise(F.col("entity_hash")))
    return first_per(entities.withColumn("key", key), ["page_id", "key"], "pos")


def entity_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, key, change_type, severity, entity_type, identity) of entities (page_id, pos, type, identity, entity_hash)."""
    a = _keyed(before).select("page_id", "key", F.col("type").alias("at"), F.col("identity").alias("ai"), F.col("entity_hash").alias("ah"))
    b = _keyed(after).select("page_id", "key", F.col("type").alias("bt"), F.col("identity").alias("bi"), F.col("entity_hash").alias("bh"))
    change = F.when(F.col("bh").isNull(), "schema_removed").when(F.col("ah").isNull(), "schema_added").when(F.col("ah") != F.col("bh"), "schema_modified")
    severity = F.when(F.col("bh").isNull(), "high").when(F.col("ah").isNull(), "info").otherwise("medium")
    both = a.join(b, ["page_id", "key"], "full_outer").withColumn("change_type", change).where("change_type is not null")
    return both.select("page_id", "key", "change_type", severity.alias("severity"), F.coalesce("at", "bt").alias("entity_type"), F.coalesce("ai", "bi").alias("identity"))


def _scalar(v: Column) -> Column:
    """A value as JSON that is equal where values count as equal: keys in order, 1.0 as 1, of an entity type and identity only,
    of a reference what it names."""

    def one(v: Column) -> Column:
        part = lambda name: F.try_variant_get(v, f"$.{name}", "string")
        ref, entity = F.struct(part("ref").alias("ref")), F.struct(part("type").alias("type"), part("identity").alias("identity"))
        held = F.when(part("ref").isNotNull(), F.to_json(ref)).otherwise(F.to_json(entity, {"ignoreNullFields": "false"}))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), held).otherwise(F.to_json(v))

    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(one(x), F.lit("null")))
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))).otherwise(one(v))


def _properties(entities: DataFrame, name: str) -> DataFrame:
    """(page_id, key, property, <name>: the value as text, <name>s: as it is compared), without what counts as absent."""
    rows = _keyed(entities).select("page_id", "key", F.try_parse_json("properties").alias("v"))
    each = entities.sparkSession.sql("SELECT page_id, r.key AS key, x.key AS property, x.value AS v FROM {rows} r, LATERAL variant_explode(r.v) x WHERE x.key IS NOT NULL", rows=rows)
    text, scalar = F.try_variant_get("v", "$", "string"), _scalar(F.col("v"))
    told = each.select("page_id", "key", "property", F.when(F.schema_of_variant("v") == "STRING", text).otherwise(scalar).alias(name), scalar.alias(f"{name}s"))
    return told.where(F.col(f"{name}s").isNotNull() & (F.trim(name) != "") & ~F.col(f"{name}s").isin("[]", "null"))


def property_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, key, property, change_type, severity, before, after) of entities on both sides whose hash differs.

    properties is a JSON object; what is none has no properties. Blank texts, null and empty lists count as absent. Values are
    compared as ``_scalar`` makes them, so the order of keys, 1 and 1.0, and what a nested entity holds beside its type
    and identity make no change. Where the properties of either side are larger than MAX_PROPERTIES, neither side's are
    compared, so that nothing seems to be removed.
    """
    large = lambda name: F.coalesce(F.octet_length("properties") > MAX_PROPERTIES, F.lit(False)).alias(name)
    ka = _keyed(before).select("page_id", "key", F.col("entity_hash").alias("ha"), large("la"))
    kb = _keyed(after).select("page_id", "key", F.col("entity_hash").alias("hb"), large("lb"))
    changed = ka.join(kb, ["page_id", "key"]).where("ha <> hb and not la and not lb").select("page_id", "key")
    a = _properties(before, "a").join(changed, ["page_id", "key"], "left_semi")
    b = _properties(after, "b").join(changed, ["page_id", "key"], "left_semi")
    both = a.join(b, ["page_id", "key", "property"], "full_outer").where("not (as <=> bs)")
    change = F.when(F.col("b").isNull(), "property_removed").when(F.col("a").isNull(), "property_added").otherwise("property_value_changed")
    severity = F.when(F.col("b").isNull(), "high").when(F.col("a").isNull(), "info").otherwise("low")
    return both.select("page_id", "key", "property", change.alias("change_type"), severity.alias("severity"), F.col("a").alias("before"), F.col("b").alias("after"))


def rich_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, key, profile, before, after, severity) of verdicts that changed; rich: array<struct<profile, status>>."""
    side = lambda frame, name: _keyed(frame).select("page_id", "key", F.explode("rich").alias("r")).select("page_id", "key", "r.profile", F.col("r.status").alias(name))
    both = side(before, "before").join(side(after, "after"), ["page_id", "key", "profile"]).where("before <> after")
    worse = (F.col("before") == "eligible") & (F.col("after") == "ineligible")
    return both.withColumn("severity", F.when(worse, "high").otherwise("low"))


def cap_properties(entities: DataFrame, max_bytes: int = MAX_PROPERTIES) -> DataFrame:
    """Oversized properties become an empty object, so that only the hash is compared."""
    return entities.withColumn("properties", F.when(F.octet_length("properties") > max_bytes, "{}").otherwise(F.col("properties")))


def change_records(changes: DataFrame) -> DataFrame:
    """before falls back to the entity's type and property."""
    spare = F.to_json(F.struct(F.col("entity_type").alias("entityType"), F.col("property")))
    return changes.withColumn("before", F.coalesce("before", spare))

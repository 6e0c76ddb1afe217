"""Scores of pages and sites from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog


def _multiplier(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, share in catalog.MULTIPLIERS.items():
        out = F.when(severity == name, share).otherwise(out)
    return out


def _weights(issues: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        weights = catalog.as_df(issues.sparkSession)
    return F.broadcast(weights.select("check_id", F.col("weight").cast("double").alias("weight")))


def deductions(issues: DataFrame, weights: DataFrame | None = None, unknown: float = catalog.UNKNOWN_WEIGHT) -> DataFrame:
    """(page_id, total): the sum over (check, severity) of weight * (1 + 0.1 log2 n) * multiplier."""
    counts = issues.groupBy("page_id", "check_id", "severity").agg(F.count("*").alias("n"))
    cost = F.coalesce("weight", F.lit(float(unknown))) * (1 + F.log2("n") * 0.1) * _multiplier(F.col("severity"))
    return counts.join(_weights(issues, weights), "check_id", "left").withColumn("cost", cost).groupBy("page_id").agg(F.sum("cost").alias("total"))


def clamp(total: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - total)), 2)


def page_scores(issues: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(page_id, score) from fail and warning findings; checks not in the catalog cost nothing."""
    counted = issues.where("status in ('fail', 'warning')") if "status" in issues.columns else issues
    return deductions(counted, weights, unknown=0).select("page_id", clamp(F.col("total")).alias("score"))


def rescore(snapshots: DataFrame, issues: DataFrame, weights: DataFrame | None = None, error_score: float | None = None) -> DataFrame:
    """``snapshots`` (page_id, score, ...) with the score of all findings; pages without any keep theirs.

    ``error_score`` is given to pages whose fetch_status is error, where wanted.
    """
    new = deductions(issues, weights).select("page_id", clamp(F.col("total")).alias("__s"))
    score = F.coalesce("__s", "score")
    if error_score is not None:
        score = F.when(F.col("fetch_status") == "error", float(error_score)).otherwise(score)
    return snapshots.join(new, "page_id", "left").withColumn("score", score).drop("__s")


def issue_counts(issues: DataFrame) -> DataFrame:
    """(page_id, issue_counts): a map of findings by severity."""
    by = issues.groupBy("page_id", "severity").agg(F.count("*").cast("int").alias("n"))
    return by.groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("issue_counts"))


def issue_total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda a, n: a + n)


def components(snapshots: DataFrame) -> DataFrame:
    """One row: avg_score, scored_pages, critical_pages of scored snapshots (score, issue_counts)."""
    critical = F.coalesce(F.element_at("issue_counts", F.lit("critical")), F.lit(0)) > 0
    return snapshots.where("score is not null").agg(F.avg("score").alias("avg_score"), F.count("score").alias("scored_pages"), F.count_if(critical).alias("critical_pages"))


def site_score(snapshots: DataFrame) -> DataFrame:
    """One row: the mean score (100 without pages), at most 79 if more than a tenth of the pages have a critical finding."""
    c = components(snapshots)
    mean = F.coalesce("avg_score", F.lit(100.0))
    capped = F.when((F.col("scored_pages") > 0) & (F.col("critical_pages") / F.col("scored_pages") > 0.1), F.least(mean, F.lit(79.0))).otherwise(mean)
    return c.select(F.round(capped, 2).alias("site_score"), "scored_pages", "critical_pages")


def category_scores(issues: DataFrame) -> DataFrame:
    """(page_id, category, score): the same formula within each category."""
    cat = F.broadcast(catalog.as_df(issues.sparkSession).select("check_id", "category", F.col("weight").cast("double").alias("weight")))
    counts = issues.groupBy("page_id", "check_id", "severity").agg(F.count("*").alias("n")).join(cat, "check_id")
    cost = F.col("weight") * (1 + F.log2("n") * 0.1) * _multiplier(F.col("severity"))
    return counts.groupBy("page_id", "category").agg(clamp(F.sum(cost)).alias("score"))


def schema_health(statuses: DataFrame) -> DataFrame:
    """One row from (status, n): round(100 * sum(n * w) / sum(n)), w: valid 1, warnings 0.7, errors 0.2, invalid 0."""
    w = F.when(F.col("status") == "valid", 1.0).when(F.col("status") == "warnings", 0.7).when(F.col("status") == "errors", 0.2).otherwise(0.0)
    return statuses.agg(F.coalesce(F.round(100 * F.sum(F.col("n") * w) / F.sum("n")), F.lit(0.0)).cast("int").alias("health"))


def schema_metrics(entities: DataFrame, verdicts: DataFrame, most_types: int = 50) -> DataFrame:
    """One row on a crawl's structured data, from entities (type, status) and verdicts (profile, status): entity_count,
    status_counts, health, rich_summary and top_types, the most frequent ones. All lists are short by what they list."""
    statuses = entities.groupBy("status").agg(F.count("*").alias("n"))
    by_status = statuses.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entity_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    rich = verdicts.groupBy("profile", "status").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("profile", "status", "n"))).alias("rich_summary"))
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("Unknown")).alias("type")
    top = entities.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(most_types)
    types = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "type", "n"))).alias("t"))
    types = types.select(F.transform("t", lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("top_types"))
    return by_status.join(schema_health(statuses)).join(rich).join(types)


def crawl_metrics(snapshots: DataFrame, issues: DataFrame, link_checks: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """One row: pages scored, site score, critical pages, findings by severity, broken links; with ``schema``
    (the row of ``schema_metrics``) a struct column of that name too."""
    by = issues.groupBy("severity").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("issues_by_severity"))
    broken = link_checks.agg(F.count_if(~F.col("ok")).alias("broken_links"))
    out = site_score(snapshots).join(by).join(broken)
    return out if schema is None else out.join(schema.select(F.struct(*schema.columns).alias("schema")))

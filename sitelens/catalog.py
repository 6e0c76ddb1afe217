"""The catalog of checks: identifiers, categories, severities and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = "1.0.0"
#: The share of a check's weight that a finding of each severity costs; also their order.
MULTIPLIERS = {"critical": 1.0, "high": 0.6, "medium": 0.3, "low": 0.1, "info": 0.0}
SEVERITIES = list(MULTIPLIERS)
#: Weight of a check that the catalog doesn't hold.
UNKNOWN_WEIGHT = 10

#: Id, severity, weight, status of a finding.
PAGE_CHECKS = [
    ("meta.title.missing", "critical", 25, "fail"),
    ("meta.title.empty", "critical", 25, "fail"),
    ("meta.title.too_long", "medium", 8, "fail"),
    ("meta.title.too_short", "low", 5, "warning"),
    ("meta.description.missing", "high", 15, "fail"),
    ("meta.description.too_long", "low", 5, "warning"),
    ("meta.description.too_short", "low", 5, "warning"),
    ("meta.canonical.missing", "high", 15, "fail"),
    ("meta.canonical.multiple", "critical", 20, "fail"),
    ("meta.canonical.non_https", "medium", 10, "fail"),
    ("meta.canonical.cross_domain", "medium", 10, "fail"),
    ("meta.robots.noindex", "critical", 30, "fail"),
    ("meta.robots.nofollow", "high", 15, "fail"),
    ("meta.robots.conflicting", "high", 12, "fail"),
    ("meta.charset.missing", "medium", 8, "fail"),
    ("meta.viewport.missing", "high", 15, "fail"),
    ("meta.viewport.not_responsive", "medium", 10, "fail"),
    ("meta.lang.missing", "medium", 8, "fail"),
    ("meta.lang.invalid_bcp47", "medium", 8, "fail"),
    ("headings.h1.missing", "high", 15, "fail"),
    ("headings.h1.multiple", "medium", 8, "fail"),
    ("headings.h1.duplicate_of_title", "info", 3, "warning"),
    ("headings.hierarchy.skipped_level", "low", 4, "warning"),
    ("headings.any.empty", "medium", 6, "fail"),
    ("images.alt.missing", "high", 12, "fail"),
    ("images.alt.empty_on_meaningful", "medium", 6, "warning"),
    ("images.dimensions.missing_width", "low", 3, "warning"),
    ("images.dimensions.missing_height", "low", 3, "warning"),
    ("images.src.broken", "high", 12, "fail"),
    ("links.internal.broken", "critical", 20, "fail"),
    ("links.external.broken", "medium", 8, "fail"),
    ("links.redirect.chain_too_long", "high", 10, "fail"),
    ("links.rel.noopener_missing_on_blank", "low", 4, "warning"),
    ("links.anchor.empty_or_generic", "low", 3, "warning"),
    ("technical.https.not_secure", "critical", 30, "fail"),
    ("technical.https.mixed_content", "high", 15, "fail"),
    ("technical.status.4xx", "critical", 30, "fail"),
    ("technical.status.5xx", "critical", 30, "fail"),
    ("technical.indexability.conflict", "medium", 10, "fail"),
    ("technical.redirect.present", "low", 4, "warning"),
    ("social.og.missing_required", "medium", 6, "fail"),
    ("social.twitter.missing_card", "low", 3, "warning"),
]
#: Checks across pages and of the fetch itself.
OTHER_CHECKS = [
    ("duplicate.title", "high", 15, "fail"),
    ("duplicate.description", "medium", 8, "fail"),
    ("duplicate.h1", "medium", 8, "fail"),
    ("technical.fetch.failed", "critical", 40, "fail"),
    ("technical.status.error", "critical", 40, "fail"),
]
#: Categories of checks whose id doesn't begin with theirs.
_CATEGORIES = {"duplicate.title": "meta", "duplicate.description": "meta", "duplicate.h1": "headings"}

CHECKS = {id_: {"severity": severity, "weight": weight, "status": status, "category": _CATEGORIES.get(id_, id_.split(".")[0])} for id_, severity, weight, status in PAGE_CHECKS + OTHER_CHECKS}


def _title(id_: str) -> str:
    return id_.replace(".", " ").replace("_", " ").capitalize()


ADVICE = {
    "meta": "Correct the element in the head of the page.",
    "headings": "Correct the outline of headings.",
    "images": "Complete the attributes of the image, or its address.",
    "links": "Correct the link, its target or its text.",
    "technical": "Correct how the server answers for this page.",
    "social": "Add the tags that previews are made from.",
}


def as_df(spark: SparkSession) -> DataFrame:
    """The catalog as a table of 47 rows."""
    rows = [(id_, _title(id_), c["category"], c["severity"], c["weight"], ADVICE[c["category"]]) for id_, c in CHECKS.items()]
    return spark.createDataFrame(rows, "check_id string, name string, category string, severity string, weight int, suggested_fix string")

"""robots.txt: documents to rule rows, and verdicts by joins."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def regex_of(pattern: str) -> str:
    """Regular expression of a path pattern: * any characters, $ at the end anchors."""
    body = pattern.removesuffix("$")
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + ("$" if body != pattern else "")


def parse_one(text: str) -> tuple[list[dict], list[str]]:
    """Groups (agents, rules, delay_ms) and sitemap URLs of one document."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    naming = False
    for line in re.split(r"\r\n|\r|\n", text.removeprefix("﻿")):
        name, colon, value = line.split("#")[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not naming or not groups:
                groups.append({"agents": [], "rules": [], "delay": None})
                naming = True
            if value:
                groups[-1]["agents"].append(value.lower())
        elif name in ("allow", "disallow"):
            naming = False
            if groups and value:
                groups[-1]["rules"].append((name == "allow", value))
        elif name == "crawl-delay":
            naming = False
            try:
                seconds = float(value or 0)
            except ValueError:
                continue
            if groups and math.isfinite(seconds) and seconds >= 0:
                groups[-1]["delay"] = int(seconds * 1000 + 0.5)
        elif name == "sitemap" and urls.parse(value):
            sitemaps.append(urls.resolve_one(value, value))
    return groups, sitemaps


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for number, group in enumerate(parse_one(body or "")[0]):
                for agent in group["agents"]:
                    rows += [(host, number, agent, allow, p, regex_of(p), group["delay"]) for allow, p in group["rules"]] or [(host, number, agent, None, None, None, group["delay"])]
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "group_no", "agent", "allow", "pattern", "regex", "delay_ms"])


def _sitemaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, s) for h, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in parse_one(b or "")[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["host", "sitemap_url"])


def parse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (host, group_no, agent, allow, pattern, regex, delay_ms), a row for each agent of a group, and sitemaps (host, sitemap_url)."""
    docs = docs.select("host", "body")
    rules = docs.mapInArrow(_rules, "host string, group_no int, agent string, allow boolean, pattern string, regex string, delay_ms long")
    return rules, docs.mapInArrow(_sitemaps, "host string, sitemap_url string")


def _chosen(rules: DataFrame, user_agent: str) -> DataFrame:
    """Rules of the groups with the longest agent name that the user agent contains; * counts 0."""
    rank = F.when(F.col("agent") == "*", 0).when(F.lit(user_agent.lower()).contains(F.col("agent")), F.length("agent")).otherwise(-1)
    ranked = rules.withColumn("rank", rank).where("rank >= 0")
    best = ranked.groupBy("host").agg(F.max("rank").alias("rank"))
    return ranked.join(best, ["host", "rank"])


def apply(pages: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """``pages`` (url, ...) with allowed: the longest matching pattern decides, Allow wins ties, no rule allows."""
    own = _chosen(rules, user_agent).where("pattern is not null").select(F.col("host").alias("__host"), "allow", "pattern", "regex").distinct()
    # a host's rules go along as one array: few rows, whatever its number of pages
    by = own.groupBy("__host").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", "regex")).alias("__rules"))
    target = F.regexp_replace(F.regexp_extract("url", r"(?i)^\s*https?://[^/?#]+([^#]*)", 1), r"^(?!/)", "/")
    joined = pages.withColumn("__host", urls.host("url")).withColumn("__path", target).join(by, "__host", "left")
    hits = F.filter("__rules", lambda r: F.rlike(F.col("__path"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("__host", "__path", "__rules")


def crawl_delay(rules: DataFrame, user_agent: str) -> DataFrame:
    """(host, delay_ms) of the first group that applies and has one."""
    own = _chosen(rules, user_agent).where("delay_ms is not null")
    return own.groupBy("host").agg(F.min_by("delay_ms", "group_no").alias("delay_ms"))

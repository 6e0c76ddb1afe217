"""Sitemaps: documents to entries, and the expansion of index trees over stored documents."""

from __future__ import annotations

import gzip
import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from .store import kept

MAX_URLS, MAX_SITEMAPS, MAX_BYTES = 50_000, 50, 50 << 20
_ENTITY = re.compile(r"&(?:amp|lt|gt|quot|apos|#x[0-9a-fA-F]+|#\d+);")


def _text(block: str, tag: str) -> str | None:
    found = re.search(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", block, re.S | re.I)
    if not found:
        return None
    value = found[1].strip()
    cdata = re.fullmatch(r"<!\[CDATA\[(.*?)\]\]>", value, re.S)
    return _ENTITY.sub(lambda m: html.unescape(m[0]), cdata[1].strip() if cdata else value)


def _unpacked(body: bytes) -> bytes:
    if body[:2] != b"\x1f\x8b":
        return body
    out = zlib.decompressobj(31).decompress(body, MAX_BYTES + 1)
    if len(out) > MAX_BYTES:
        raise ValueError("larger than a sitemap may be")
    if not out:
        gzip.decompress(body)
    return out


def parse_one(body: bytes | None) -> tuple[str, list[tuple[str, str | None]], str | None]:
    """(kind, entries, error) of a document: kind is urlset, index or error."""
    try:
        xml = _unpacked(bytes(body or b"")).decode("utf-8", "replace")
    except (OSError, EOFError, ValueError, zlib.error) as e:
        return "error", [], f"gzip decompression failed: {e}"
    for kind, root, item in (("index", "sitemapindex", "sitemap"), ("urlset", "urlset", "url")):
        if re.search(rf"<{root}[\s>]", xml, re.I):
            blocks = (m[1] for m in re.finditer(rf"<{item}(?:\s[^>]*)?>(.*?)</{item}\s*>", xml, re.S | re.I))
            pairs = ((_text(b, "loc"), _text(b, "lastmod") or None) for b in blocks)
            return kind, [(loc, mod) for loc, mod in pairs if loc and urls.parse(loc)], None
    return "error", [], "neither a urlset nor a sitemapindex"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kind, entries, error = parse_one(body)
            rows += [(url, kind, k, loc, mod, None) for k, (loc, mod) in enumerate(entries)] or [(url, kind, 0, None, None, error)]
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["sitemap_url", "kind", "pos", "loc", "lastmod", "error"])


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """(sitemap_url, kind, pos, loc, lastmod, error) of documents (sitemap_url, body); one without entries keeps a row."""
    return docs.select("sitemap_url", F.col("body").cast("binary")).mapInArrow(_parse, "sitemap_url string, kind string, pos int, loc string, lastmod string, error string")


def expand_tree(docs: DataFrame, root: str, max_urls: int | None = MAX_URLS, max_sitemaps: int = MAX_SITEMAPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (loc, lastmod, sitemap_url), errors (url, message) and one row of stats below ``root``.

    The tree is followed by joins, a level at a time; a document's place is the least of the ways to it (positions
    from the root), which is depth first in document order, so ways around in circles never count. The first
    ``max_sitemaps`` documents by place are read. Entries are distinct by loc in the order found, ``max_urls`` of them at most; with None, all.
    """
    spark = docs.sparkSession
    parsed = kept(parse_sitemaps(docs), "sitemap")
    listed = parsed.where(f"kind = 'index' and loc is not null and pos < {MAX_URLS}").select(F.col("sitemap_url").alias("url"), F.col("loc"), "pos")
    reached = spark.createDataFrame([(root, [])], "url string, way array<int>")
    frontier = reached
    while True:
        below = frontier.join(listed, "url").select(F.col("loc").alias("url"), F.concat("way", F.array("pos")).alias("way"))
        merged = kept(reached.unionByName(below).groupBy("url").agg(F.min("way").alias("way")), "reached")
        frontier = merged.join(reached, ["url", "way"], "left_anti")
        if frontier.isEmpty():
            break
        reached = merged
    first = reached.orderBy("way").limit(max_sitemaps)
    order = first.select(F.col("url").alias("sitemap_url"), F.row_number().over(Window.orderBy("way")).alias("visit"))  # max_sitemaps rows
    met = parsed.join(F.broadcast(order), "sitemap_url")
    found = met.where("kind = 'urlset' and loc is not null").groupBy("loc").agg(F.min(F.struct("visit", "pos", "lastmod", "sitemap_url")).alias("f"))
    found = found.select("loc", "f.lastmod", "f.sitemap_url", "f.visit", "f.pos")
    ordered = found.orderBy("visit", "pos")
    entries = (ordered if max_urls is None else ordered.limit(max_urls)).select("loc", "lastmod", "sitemap_url")
    errors = met.where("error is not null").select(F.col("sitemap_url").alias("url"), F.col("error").alias("message"))
    missing = order.join(parsed.select("sitemap_url").distinct(), "sitemap_url", "left_anti")
    errors = errors.unionByName(missing.select(F.col("sitemap_url").alias("url"), F.lit("not found").alias("message")))
    counts = found.agg(F.count("*").alias("n")).join(reached.agg(F.count("*").alias("sitemaps")))
    most = F.col("n") if max_urls is None else F.lit(max_urls)
    stats = counts.select(F.least("n", most).alias("total"), F.least("sitemaps", F.lit(max_sitemaps)).cast("int").alias("sitemap_count"), ((F.col("sitemaps") > max_sitemaps) | (F.col("n") > most)).alias("truncated"))
    return entries, errors, stats


def preview(docs: DataFrame, root: str, sample: int = 8, max_urls: int | None = MAX_URLS) -> DataFrame:
    """One row: sample of normalised URLs, total, sitemap_count, truncated, error_count."""
    entries, errors, stats = expand_tree(docs, root, max_urls)
    some = entries.limit(sample).select(urls.normalize("loc").alias("url")).agg(F.sort_array(F.collect_list("url")).alias("sample"))
    return stats.join(some).join(errors.agg(F.count("*").alias("error_count")))

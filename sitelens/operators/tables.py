"""Table functions for queries in SQL text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions import elements, urls

_LINKS = "pos int, href string, text string, rel string, internal boolean, nofollow boolean"
#: White space that a browser's trim takes from both ends.
_SPACE = " \t\n\x0b\x0c\r\xa0﻿"


class ExtractLinks:
    """The links of a page, in page order: what ``artifacts.extract`` has in ``links``, without places.

    Null html: no rows. Without a base only absolute addresses are links, and none is internal.
    """

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        page = elements.Page(html or "")
        own, pos = urls.domain_of_url(base) if base else None, 0
        for n, tag in enumerate(page.tags):
            attrs = page.attrs[n]
            href = urls.resolve_one(attrs["href"], base) if tag == "a" and "href" in attrs else None
            if href is not None:
                rel = attrs.get("rel")
                yield pos, href, page.text(n).strip(_SPACE), rel, own is not None and urls.domain_of_url(href) == own, "nofollow" in re.split(r"\s+", (rel or "").lower())
                pos += 1


def register_all(spark: SparkSession) -> None:
    """``extract_links(html, base)`` becomes a name in the session's SQL: FROM pages, LATERAL extract_links(html, url)."""
    spark.udtf.register("extract_links", udtf(ExtractLinks, returnType=_LINKS))

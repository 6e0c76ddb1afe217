"""Page artifacts: one Arrow pass makes flat elements of a page, and columns read all fields from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements, urls

#: Columns of a fetched page that are carried along, with their type and what stands in where a source lacks them.
CARRIED = {"page_id": "bigint", "url": "string", "final_url": "string", "http_status": "int", "rendered": "boolean", "redirect_chain": "array<struct<url: string, status: int>>"}
#: Attributes that hold an image's address until it is shown, the first one before the others.
LAZY = ["data-src", "data-lazy-src", "data-lazy", "data-original", "data-echo"]
#: Elements other than images that load a resource, with the attribute that names it.
LOADED = {"script": "src", "iframe": "src", "source": "src", "audio": "src", "video": "src", "embed": "src", "object": "data"}
SNIPPET = elements.SOURCE - 1


def attribute(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def _filled(value: Column) -> Column:
    return F.when(trimmed(value) != "", value)


def _rel(e: Column) -> Column:
    return F.split(F.lower(F.coalesce(attribute(e, "rel"), F.lit(""))), r"\s+")


def _is(*tags: str) -> Callable[[Column], Column]:
    return lambda e: e["tag"].isin(*tags)


#: Tasks a core that pages are dealt to, so that none is long and a slow one holds up little.
TASKS_A_CORE = 4


def spread(pages: DataFrame) -> DataFrame:
    """``pages`` dealt over all cores by page: partitions of a file may be many, and yet all its pages in one, where it is one row group."""
    if pages.isStreaming:
        return pages
    return pages.repartition(TASKS_A_CORE * pages.sparkSession.sparkContext.defaultParallelism, F.xxhash64("page_id"))


def elements_of(pages: DataFrame, terminated: bool = False) -> DataFrame:
    """``pages`` with els and texts in place of html: the flat elements and the pieces of text of each page."""
    kept = [c for c in pages.columns if c != "html"]
    ddl = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    read = spread(pages.select(*kept, "html")).mapInArrow(partial(elements.batches, unescape=elements.terminated) if terminated else elements.batches, f"{ddl}, page {elements.PAGE}")
    return read.select(*kept, "page.els", "page.texts")


def text_of(e: Column) -> Column:
    """All text between an element's tags; ``texts`` is a column beside its list."""
    return trimmed(F.array_join(F.transform(F.slice("texts", e["first_text"] + 1, e["n_texts"]), lambda t: t["text"]), ""))


def selector(e: Column, steps: Column) -> Column:
    """A CSS path of at most six steps from an element with an id, or the outermost; ``steps`` are (step, named) of all elements."""

    def to_named(way: Column) -> Column:
        named = F.array_position(F.transform(way, lambda s: s["named"]), True).cast("int")
        return F.slice(way, 1, F.when(named > 0, named).otherwise(elements.STEPS))

    way = F.filter(F.transform(e["up"], lambda i: F.get(steps, i)), lambda s: s["step"].isNotNull())
    return F.array_join(F.reverse(F.transform(urls.bound(way, to_named), lambda s: s["step"])), " > ")


def _step(e: Column) -> Column:
    place = F.concat(e["tag"], F.lit(":nth-of-type("), e["nth"].cast("string"), F.lit(")"))

    def of(own: Column) -> Column:
        step = F.when(own != "", F.concat(F.lit("#"), own)).when(e["alike"] > 1, place).otherwise(e["tag"])
        return F.struct(F.when(e["tag"] != "html", step).alias("step"), (own != "").alias("named"))

    return urls.bound(F.coalesce(attribute(e, "id"), F.lit("")), of)


def snippet(e: Column) -> Column:
    return F.when(F.length(e["source"]) > SNIPPET, F.concat(F.substring(e["source"], 1, SNIPPET), F.lit("…"))).otherwise(e["source"])


def _where(e: Column, steps: Column) -> list[Column]:
    return [selector(e, steps).alias("selector"), snippet(e).alias("snippet")]


def _placed(items: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` each item and the page's steps and domain, which are computed once a page: a column that only a function of an
    array names is put into it by the optimizer, and computed again for each item."""
    return urls.bound(F.struct("steps", "domain"), lambda page: F.transform(items, lambda e: of(e, page)))


def _candidate(srcset: Column) -> Column:
    """The first address of a list of image candidates."""
    return F.nullif(F.regexp_extract(srcset, r"^\s*([^\s,]+)", 1), F.lit(""))


def _address(lazy: Sequence[str]) -> Callable[[Column], Column]:
    """The address in an element's attributes, as it is written there."""

    def of(e: Column) -> Column:
        image = F.coalesce(_filled(attribute(e, "src")), _later(e, lazy), attribute(e, "src"))
        out = F.when(e["tag"].isin("a", "link"), attribute(e, "href")).when(e["tag"] == "img", image)
        for attr in sorted(set(LOADED.values())):
            out = out.when(e["tag"].isin(*(t for t, a in LOADED.items() if a == attr)), attribute(e, attr))
        return out

    return of


def _later(e: Column, lazy: Sequence[str]) -> Column:
    """The address that an image without one is given when it is shown."""
    return F.coalesce(*(_filled(attribute(e, a)) for a in lazy), _candidate(attribute(e, "data-srcset")), _candidate(attribute(e, "srcset")))


def _first(items: Column, when: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, when), 0)


def _named(name: str) -> Column:
    """Content of the first meta element of a name."""
    return trimmed(attribute(_first(F.col("metas"), lambda m: F.lower(attribute(m, "name")) == name), "content"))


def _tags(prefix: str, first: str, second: str) -> Column:
    """Map of the meta elements whose name begins with ``prefix``; of equal names the first counts."""
    own = lambda m: F.coalesce(F.lower(attribute(m, first)).startswith(prefix), F.lit(False)) | F.coalesce(F.lower(attribute(m, second)).startswith(prefix), F.lit(False))
    named = F.filter("metas", lambda m: own(m) & attribute(m, "content").isNotNull())
    keys = F.transform(named, lambda m: F.lower(F.coalesce(attribute(m, first), attribute(m, second))))
    values = F.transform(named, lambda m: trimmed(attribute(m, "content")))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1))


def _robots() -> Column:
    raw, sent = _named("robots"), header(F.col("headers"), "x-robots-tag")
    has = lambda value, *names: F.arrays_overlap(tokens(value), F.array(*map(F.lit, names)))
    return F.struct(raw.alias("raw"), has(raw, "noindex", "none").alias("noindex"), has(raw, "nofollow", "none").alias("nofollow"), sent.alias("header_raw"), has(sent, "noindex", "none").alias("header_noindex"))


def _charset() -> Column:
    own = attribute(_first(F.col("metas"), lambda m: attribute(m, "charset").isNotNull()), "charset")
    declared = attribute(_first(F.col("metas"), lambda m: F.lower(attribute(m, "http-equiv")) == "content-type"), "content")
    given = F.regexp_extract(declared, r"(?i)charset\s*=\s*([^;]+)", 1)
    return F.coalesce(*(F.nullif(F.lower(trimmed(c)), F.lit("")) for c in (own, given)))


def _image(e: Column, page: Column, lazy: Sequence[str]) -> Column:
    given = _filled(attribute(e, "src"))
    plain = [attribute(e, n).alias(n) for n in ("alt", "width", "height", "loading")]
    src = F.coalesce(e["url"], e["address"], F.lit("")).alias("src")
    return F.struct(src, *plain, (given.isNull() & _later(e, lazy).isNotNull()).alias("lazy"), *_where(e, page["steps"]))


def _link(e: Column, page: Column) -> Column:
    internal = F.coalesce(urls.registrable_domain(urls.host(e["url"])) == page["domain"], F.lit(False))
    return F.struct(
        e["url"].alias("href"), text_of(e).alias("text"), attribute(e, "rel").alias("rel"), internal.alias("internal"), F.array_contains(_rel(e), "nofollow").alias("nofollow"),
        (F.lower(F.coalesce(attribute(e, "target"), F.lit(""))) == "_blank").alias("target_blank"), *_where(e, page["steps"]),
    )


def extract(pages: DataFrame, lazy: Sequence[str] = LAZY, terminated: bool = False) -> DataFrame:
    """A row of artifacts for each page of ``sources.read_pages``; html itself is not carried along.

    ``lazy`` names further attributes that hold the addresses of images. Null and empty pages have no elements. As browsers do, texts
    are read with ``&amp`` for ``&`` even without its semicolon; ``terminated`` asks for the semicolon.
    """
    c, rel = F.col, lambda name: (lambda e: (e["tag"] == "link") & F.array_contains(_rel(e), name))
    read = elements_of(pages.select(*CARRIED, "headers", "html"), terminated).withColumn("addresses", F.transform("els", _address(lazy)))
    read = read.withColumn("resolved", urls.resolve_all("addresses", "final_url"))
    names = ["tag", "up", "nth", "alike", "first_text", "n_texts", "in_head", "attrs", "source"]
    whole = lambda e, i: F.struct(*(e[n].alias(n) for n in names), _address(lazy)(e).alias("address"), F.get("resolved", i).alias("url"))
    of = lambda *tags: F.filter("els", _is(*tags))
    # what needs no address is taken from the elements before theirs are resolved, so a query of titles alone resolves none
    plain = [of("meta").alias("metas"), of("h1", "h2", "h3", "h4", "h5", "h6").alias("heads"), of("title").alias("titles"), of("body").alias("bodies")]
    read = read.select(*CARRIED, "headers", "texts", *plain, F.transform("els", whole).alias("els"), F.transform("els", _step).alias("steps"), urls.registrable_domain(urls.host("final_url")).alias("domain"))
    read = read.withColumn("https", F.coalesce(F.lower("final_url").startswith("https:"), F.lit(False)))
    level = lambda e: F.substring(e["tag"], 2, 1).cast("int").alias("level")
    loads = F.filter("els", lambda e: _is("img", *LOADED)(e) | rel("stylesheet")(e))
    read = read.withColumn("headings", _placed(F.col("heads"), lambda e, page: F.struct(level(e), text_of(e).alias("text"), *_where(e, page["steps"]))))
    read = read.withColumns({
        "title": text_of(F.coalesce(_first(c("titles"), lambda e: e["in_head"]), F.get("titles", 0))),
        "meta_description": _named("description"),
        "h1_text": F.nullif(_first(c("headings"), lambda h: h["level"] == 1)["text"], F.lit("")),
    })
    body = F.get("bodies", 0)
    inside = F.when(body.isNotNull(), F.slice("texts", body["first_text"] + 1, body["n_texts"])).otherwise(c("texts"))
    words = F.regexp_count(F.array_join(F.transform(F.filter(inside, lambda t: t["seen"]), lambda t: t["text"]), ""), F.lit(r"(?U)[^\s]+"))
    insecure = F.filter(F.transform(loads, lambda e: e["url"]), lambda u: u.startswith("http://"))
    links = F.filter("els", lambda e: (e["tag"] == "a") & e["url"].isNotNull())
    other = F.filter("els", lambda e: rel("alternate")(e) & attribute(e, "hreflang").isNotNull() & attribute(e, "href").isNotNull())
    return read.select(
        *CARRIED,
        "title",
        "meta_description",
        F.filter(F.transform(F.filter("els", rel("canonical")), lambda e: e["url"]), lambda u: u.isNotNull()).alias("canonicals"),
        _robots().alias("robots"),
        _charset().alias("charset"),
        F.nullif(trimmed(attribute(_first(c("els"), lambda e: e["tag"] == "html"), "lang")), F.lit("")).alias("html_lang"),
        _named("viewport").alias("viewport"),
        F.exists("els", rel("icon")).alias("favicon"),
        _tags("og:", "property", "name").alias("og_tags"),
        _tags("twitter:", "name", "property").alias("twitter_tags"),
        F.transform(other, lambda e: F.struct(trimmed(attribute(e, "hreflang")).alias("lang"), F.coalesce(e["url"], trimmed(e["address"])).alias("href"))).alias("hreflang"),
        "headings",
        _placed(of("img"), lambda e, page: _image(e, page, lazy)).alias("images"),
        _placed(links, _link).alias("links"),
        words.alias("word_count"),
        "https",
        F.when(c("https"), F.array_distinct(insecure)).otherwise(F.array().cast("array<string>")).alias("mixed_content_urls"),
        *(header(c("headers"), n.replace("_", "-")).alias(n) for n in ("etag", "last_modified", "content_type")),
        normalized_hash(c("title")).alias("title_hash"),
        normalized_hash(c("meta_description")).alias("description_hash"),
        normalized_hash(c("h1_text")).alias("h1_hash"),
        "h1_text",
    )


def tokens(raw: Column) -> Column:
    """Directive tokens of a robots value."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(raw, F.lit(""))), ","), lambda t: F.trim(t)), lambda t: t != "")


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, r"^[\s ﻿]+|[\s ﻿]+$", "")


def normalized_hash(column: Column) -> Column:
    plain = F.nullif(F.lower(trimmed(column)), F.lit(""))
    return F.md5(plain)


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def header(headers: Column, name: str) -> Column:
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(entries, 0)["value"]


def needs_render(html: Column) -> Column:
    """An application's empty root element, and less than 200 characters of visible text."""
    shell = html.rlike(r"(?i)<div[^>]+id\s*=\s*[\"'](root|app|__next)[\"']")
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", ""), r"<[^>]+>", " ")
    return F.coalesce(shell & (F.length(F.trim(F.regexp_replace(visible, r"\s+", " "))) < 200), F.lit(False))

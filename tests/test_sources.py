import gzip

import pytest
from pyspark.sql import functions as F
from sitelens.plans import more, registry  # noqa: F401
from sitelens.sources import readers, robots, sitemap, store, versioned

ROBOTS = """User-agent: *
Disallow: /private
Allow: /private/open$
Crawl-delay: 2

User-agent: SiteBot
User-agent: OtherBot
Disallow: /*.pdf
Disallow:
Sitemap: https://example.com/sitemap.xml
Sitemap: /relative.xml
"""


def test_robots(spark):
    docs = spark.createDataFrame([("example.com", ROBOTS)], "host string, body string")
    rules, maps = robots.parse(docs)
    assert [r.sitemap_url for r in maps.collect()] == ["https://example.com/sitemap.xml"]
    urls = spark.createDataFrame([(f"https://example.com{p}",) for p in ("/", "/private", "/private/open", "/private/open/x", "/a.pdf")] + [("https://else.com/private",)], "url string")
    verdict = lambda agent: {r.url.split(".com")[-1] if "example" in r.url else "else": r.allowed for r in robots.apply(urls, rules, agent).collect()}
    assert verdict("Mozilla") == {"/": True, "/private": False, "/private/open": True, "/private/open/x": False, "/a.pdf": True, "else": True}
    assert verdict("my sitebot/1.0") == {"/": True, "/private": True, "/private/open": True, "/private/open/x": True, "/a.pdf": False, "else": True}
    assert [r.delay_ms for r in robots.crawl_delay(rules, "x").collect()] == [2000]
    assert robots.crawl_delay(rules, "sitebot").collect() == []


def urlset(*locs):
    return ("<urlset>" + "".join(f"<url><loc>{u}</loc><lastmod>2024-01-0{k + 1}</lastmod></url>" for k, u in enumerate(locs)) + "</urlset>").encode()


def test_sitemaps(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://e.com/{n}</loc></sitemap>" for n in ("a.xml", "b.xml.gz", "gone.xml", "bad.xml", "root.xml")) + "</sitemapindex>"
    docs = spark.createDataFrame(
        [
            ("https://e.com/root.xml", index.encode()),
            ("https://e.com/a.xml", urlset("https://e.com/1?x=1&amp;y=2", "<![CDATA[https://e.com/2]]>", "mailto:x", "https://e.com/1?x=1&amp;y=2")),
            ("https://e.com/b.xml.gz", gzip.compress(urlset("https://e.com/3", "https://e.com/2"))),
            ("https://e.com/bad.xml", b"\x1f\x8bnot gzip"),
            ("https://e.com/other.xml", b"<html></html>"),
        ],
        "sitemap_url string, body binary",
    )
    entries, errors, stats = sitemap.expand_tree(docs, "https://e.com/root.xml")
    assert [r.loc for r in entries.collect()] == ["https://e.com/1?x=1&y=2", "https://e.com/2", "https://e.com/3"]
    assert {r.url for r in errors.collect()} == {"https://e.com/gone.xml", "https://e.com/bad.xml"}
    assert tuple(stats.first()) == (3, 5, False)
    _, _, stats = sitemap.expand_tree(docs, "https://e.com/root.xml", max_urls=2)
    assert tuple(stats.first()) == (2, 5, True)
    _, _, stats = sitemap.expand_tree(docs, "https://e.com/root.xml", max_sitemaps=2)
    assert stats.first().truncated
    row = sitemap.preview(docs, "https://e.com/root.xml").first()
    assert row.total == 3 and row.error_count == 2 and len(row["sample"]) == 3
    assert sitemap.parse_sitemaps(docs).where("sitemap_url like '%other.xml'").first().error


def test_all_changes_are_appended(spark, sf, monkeypatch):
    written = []
    append = store.append_changes
    monkeypatch.setattr(store, "append_changes", lambda frame, path: (written.append(path), append(frame, path)))
    registry.QUERIES["snk_2_append_changes"](spark, sf)
    rows = spark.read.parquet(written[0])
    assert len(written) == 2 and len(set(written)) == 1
    assert rows.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count() and rows.where("crawl_id > 3").count() > 0
    assert rows.select("crawl_bucket").distinct().count() <= store.CHANGE_BUCKETS


def test_csv(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("﻿name,url\na, https://e.com/1 \nb\n,\nc,https://e.com/2,extra\n", encoding="utf-8")
    got = readers.csv_urls(spark, str(path), "url")
    assert sorted(r.url for r in got.collect()) == ["https://e.com/1", "https://e.com/2"]
    gate = readers.validate_csv_urls(got).first()
    assert gate.accepted and gate.row_count == 2
    many = spark.createDataFrame([("x",)] * 2 + [("https://e.com",)] * 8, "url string")
    assert readers.validate_csv_urls(many).first().reason == "too many invalid URLs"
    assert readers.validate_csv_urls(many.limit(0)).first().reason == "no rows"
    assert readers.first_invalid(many).count() == 1


def test_seeds(spark):
    a = spark.createDataFrame([("https://E.com/x", "2024"), ("bad", "2020")], "url string, lastmod string")
    b = spark.createDataFrame([("https://e.com/x#y", True)], "url string, allow_discovery boolean")
    assert [tuple(r) for r in readers.resolve_seeds([a, b], "https://e.com").collect()] == [("https://e.com/x", True, "2024", 0)]
    assert [r.url for r in readers.resolve_seeds([a.where("url = 'bad'")], "https://e.com").collect()] == ["https://e.com/"]


def test_store(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "crawl_id int, page_id int, v string")
    assert store.replaced(rows((1, 1, "a"), (1, 2, "a")), rows((1, 2, "b"))).count() == 2
    store.append_changes(rows((1, 1, "a")), str(tmp_path / "changes"))
    store.append_changes(rows((1, 1, "b")), str(tmp_path / "changes"))
    assert spark.read.parquet(str(tmp_path / "changes")).count() == 2
    store.to_csv(spark.createDataFrame([("=1+1", 'say "x", y')], "a string, b string"), ["a", "b"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).select("a", "b").first() == ("'=1+1", 'say "x", y')
    store.to_json(rows((1, 1, "a")), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert store.archive_bodies(spark.createDataFrame([("x",), ("x",), (None,)], "html string")).count() == 1
    gone = store.remove_group({"crawls": rows((1, 1, "a")).withColumn("group_id", F.lit("g")), "issues": rows((1, 1, "a"), (2, 1, "a")), "pages": spark.range(1)}, "g")
    assert gone["crawls"].count() == 0 and gone["issues"].count() == 1 and gone["pages"].count() == 1


def _facts(spark, path):
    return {name: None if (x := store.facts(spark, path, name)) is None else sorted((r.crawl_id, r.page_id, r.v) for r in x.collect()) for name in ("snapshots", "issues", "entities")}


def test_pages_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "crawl_id int, page_id int, v string")
    assert _facts(spark, path) == {"snapshots": None, "issues": None, "entities": None}
    first = [(1, 10, "a"), (1, 11, "a"), (2, 10, "a"), (None, 10, "a")]
    store.replace_snapshots(rows(*first), rows(*first, *first), rows(*first[:2]), path)
    assert store.replace_snapshots(rows((1, 10, "b"), (None, 10, "b")), rows(), rows((1, 10, "b")), path, "second") == 1
    assert store.replace_snapshots(rows((1, 11, "x")), rows(), rows(), path, "second") == 1  # of a name that was written: left out
    key = lambda r: (str(r[0]), r[1], r[2])
    want = {"snapshots": [(1, 10, "b"), (1, 11, "a"), (2, 10, "a"), (None, 10, "a"), (None, 10, "b")], "issues": sorted([(1, 11, "a"), (2, 10, "a"), (None, 10, "a")] * 2, key=key), "entities": [(1, 10, "b"), (1, 11, "a")]}
    now = lambda: {n: sorted(((r.crawl_id, r.page_id, r.v) for r in store.facts(spark, path, n).collect()), key=key) for n in want}
    assert now() == {n: sorted(v, key=key) for n, v in want.items()}
    assert versioned.compact(spark, path) == 2 and len(versioned.commits(spark, path)) == 1
    assert now() == {n: sorted(v, key=key) for n, v in want.items()}
    assert versioned.vacuum(spark, path) == 0 and versioned.vacuum(spark, path, -60) == 8 and now() == {n: sorted(v, key=key) for n, v in want.items()}
    store.replace_snapshots(rows((2, 10, "c")), rows(), rows((2, 10, "c")), path)
    assert (2, 10, "c") in now()["snapshots"] and len(now()["issues"]) == 4 and len(now()["entities"]) == 3


def test_a_write_that_breaks_off_is_never_seen(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "crawl_id int, page_id int, v string")
    old = rows((1, 1, "old"), (1, 2, "old"))
    store.replace_snapshots(old, old, old, path)
    before = _facts(spark, path)
    new = rows((1, 1, "new"))
    with pytest.raises(Exception, match="broken"):  # between two tables
        store.replace_snapshots(new, new.withColumn("v", F.raise_error(F.lit("broken"))), new, path, "retried")
    assert _facts(spark, path) == before
    versioned.stage(spark, path, {"snapshots": new, "issues": new, "entities": new}, new.select("crawl_id", "page_id"), "retried")  # before the commit
    (tmp_path / "commits" / "000000000001" / "_temporary").mkdir(parents=True)  # during it
    assert _facts(spark, path) == before
    assert store.replace_snapshots(new, new, new, path, "retried") == 2
    assert _facts(spark, path) == {n: [(1, 1, "new"), (1, 2, "old")] for n in before}


def test_gate_of_files(spark, tmp_path):
    def gate(content, name="u.csv"):
        (tmp_path / name).write_bytes(content)
        r = readers.gate_csv_file(spark, str(tmp_path / name)).first()
        return r.reason, r.row_count, r.valid_count, r.accepted

    assert gate(b"") == ("empty file", None, None, False)
    assert gate(b"url\n" + b"x" * 9000 + b"\0") == ("no valid URL", 1, 0, False)  # beyond the head
    assert gate(b"url\nhttps://e.com/\0") == ("binary content", None, None, False)
    assert gate(b"link\nhttps://e.com/") == ("no column", None, None, False)
    assert gate(b"url\n") == ("no rows", 0, 0, False)
    assert gate("\ufeffnote, url\n\n\"a\n\"\"b\"\"\", https://e.com/x ,ragged\r\nc\n".encode() + b"n,https://e.com\n" * 30) == (None, 32, 31, True)

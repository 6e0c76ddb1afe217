import random

import pytest
from pyspark.sql import functions as F
from sitelens.functions import urls
from sitelens.sources import readers

CASES = [
    ("HTTP://Example.COM/Path", None, "http://example.com/Path"),
    ("https://example.com/a#frag", None, "https://example.com/a"),
    ("http://example.com:80/", None, "http://example.com/"),
    ("https://example.com:443/x", None, "https://example.com/x"),
    ("https://example.com:8443/x", None, "https://example.com:8443/x"),
    ("https://example.com", None, "https://example.com/"),
    ("https://example.com/a/", None, "https://example.com/a/"),
    ("https://example.com/a/./b/../c", None, "https://example.com/a/c"),
    ("https://example.com//a///b", None, "https://example.com/a/b"),
    ("https://example.com/%7Euser/%c3%a9", None, "https://example.com/~user/%C3%A9"),
    ("https://example.com/?b=2&a=1&b=1", None, "https://example.com/?a=1&b=2&b=1"),
    ("https://example.com/?q=a%20b", None, "https://example.com/?q=a+b"),
    ("../x?z=1", "https://example.com/a/b/c", "https://example.com/a/x?z=1"),
    ("//other.org/p", "https://example.com/", "https://other.org/p"),
    ("not a url", None, None),
    ("mailto:a@example.com", None, None),
    ("javascript:void(0)", "https://example.com/", None),
    (None, None, None),
]


@pytest.mark.parametrize("raw,base,want", CASES)
def test_normalize(raw, base, want):
    assert urls.normalize_one(raw, base) == want


def test_normalize_is_idempotent_and_strips():
    rng = random.Random(5)
    for _ in range(300):
        raw = "https://Ex.com" + "".join(rng.choice(["/", "a", "%41", "é", "..", ".", "?", "&", "=", "b", " ", "~", "%2f"]) for _ in range(12))
        once = urls.normalize_one(raw)
        assert once is None or urls.normalize_one(once) == once, raw
    assert urls.normalize_one("https://e.com/?utm=1&a=2", strip_params=("utm",)) == "https://e.com/?a=2"
    assert urls.normalize_one("https://e.com/?a=2", strip_query=True) == "https://e.com/"


def test_columns(spark):
    rows = [("https://WWW.Example.co.uk:8080/a/b?x#y",), ("http://10.0.0.1/",), ("ftp://x.org/",), (None,)]
    frame = spark.createDataFrame(rows, "u string")
    got = frame.select(urls.registrable_domain(urls.host("u")), urls.origin("u"), urls.host_no_www("u"), urls.path_of("u"), urls.is_http("u")).collect()
    assert tuple(got[0]) == ("example.co.uk", "https://www.example.co.uk:8080", "example.co.uk", "/a/b", True)
    assert tuple(got[1]) == ("10.0.0.1", "http://10.0.0.1", "10.0.0.1", "/", True)
    assert got[2][4] is False and got[3][4] is False and got[3][0] is None
    for host in ("a.b.example.com", "example.com.", "x.co.uk", "localhost", "1.2.3.4", "b.com.au"):
        column = frame.select(urls.registrable_domain(F.lit(host))).first()[0]
        assert column == urls.domain_of_host(host)


def test_scope(spark):
    cases = [
        ("https://example.com/blog", "/blog", [], [], "in_scope"),
        ("https://shop.example.com/blog/x", "/blog", [], [], "in_scope"),
        ("https://example.com/blogger", "/blog", [], [], "out_of_scope"),
        ("https://example.org/blog", "/blog", [], [], "out_of_scope"),
        ("mailto:x@example.com", None, [], [], "out_of_scope"),
        ("https://example.com/a/b/c.pdf", None, [], ["/a/**.pdf"], "blocked"),
        ("https://example.com/a/b/c.pdf", None, [], ["/a/*.pdf"], "in_scope"),
        ("https://example.com/x", None, ["/a/**"], [], "blocked"),
        ("https://example.com/a/x", None, ["a/?"], ["/b"], "in_scope"),
        ("https://example.org/x", None, [], ["**"], "out_of_scope"),
    ]
    for url, scope, allow, block, want in cases:
        frame = spark.createDataFrame([(url,)], "url string")
        assert frame.select(readers.scope_class("url", "https://www.example.com", scope, allow, block)).first()[0] == want, url

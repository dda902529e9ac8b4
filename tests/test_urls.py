import posixpath
import random
from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import functions as F

from siltstone.functions import ats, documents, urls

URLS = [
    "HTTP://Example.COM:80/A/b?q=1#f", "https://h:443", "https://h:444/x", "http://h:99999/", "http://h:x/", "ftp://h/", "//h/x", "/x", "", "   http://h/ a b ", "http://u:p@h/x", "http://@h/",
    "http://[::1]:8080/x", "https:///x", "http://h?x=1", "http://h#y", "http://h/a.tar.gz", "http://h/.css", "http://h/a.PDF?x", "http://h/a.b/c", "http://h/..css", "ht\ntp://h/\tx", "mailto:a@b.c", "http://h:/x",
]


def by_library(url):
    """The normal form by the standard library."""
    try:
        split = urlsplit(url)
        port = split.port
    except ValueError:
        return None
    if split.scheme not in ("http", "https") or not split.hostname:
        return None
    usual = port in (None, {"http": 80, "https": 443}[split.scheme])
    return urlunsplit((split.scheme, split.hostname if usual else f"{split.hostname}:{port}", split.path or "/", split.query, ""))


def test_normal_form_equals_the_library(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", urls.normalise("url").alias("n"), urls.suffix(urls.part("url", 3)).alias("s")).collect()
    for r in rows:
        assert r.n == by_library(r.url), r.url
        assert r.s == posixpath.splitext(urlsplit(r.url).path.lower())[1], r.url
    assert spark.range(1).select(urls.normalise(F.lit(None).cast("string")).alias("n")).first().n is None


def test_normal_form_of_generated_urls(spark):
    rng = random.Random(6)
    pick = lambda chars, most: "".join(rng.choice(chars) for _ in range(rng.randrange(most + 1)))
    many = [
        rng.choice(["http", "https", "HTTP", "x"]) + "://" + pick("aZ.@:", 6) + rng.choice(["", ":", ":80", ":443", ":65536", ":0"]) + pick("/a.", 8) + rng.choice(["", "?", "?q", "#", "#f", "?q#f"])
        for _ in range(3000)
    ]
    rows = spark.createDataFrame([(u,) for u in many], "url string").select("url", urls.normalise("url").alias("n")).collect()
    again = spark.createDataFrame([(r.n,) for r in rows if r.n], "url string").select("url", urls.normalise("url").alias("n")).collect()
    assert [r for r in rows if r.n != by_library(r.url)] == []
    assert all(r.n == r.url for r in again)


def test_resolution_equals_the_library_without_dot_segments(spark):
    refs = ["", "/a", "b", "b/c?x", "?q", "#f", "//h2/z", "https://o/", "mailto:x"]
    bases = ["http://h/a/b?q=1", "https://h:8/", "http://h"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string").select("*", urls.resolve("base", F.col("ref")).alias("got")).collect()
    for r in rows:
        assert r.got == urljoin(r.base, r.ref), (r.base, r.ref)


def test_scope_stops_at_segments(spark):
    cases = [
        ("https://h/docs/a", "https://h/docs", True), ("https://h/docs-old", "https://h/docs", False), ("https://h/docs/", "https://h/docs", False), ("http://h/docs/a", "https://h/docs", False),
        ("https://H:443/docs/a", "https://h/docs/", True), ("https://h/x", "https://h/", True), ("https://h/", "https://h/", False), ("https://h:bad/x", "https://h/", False), (None, "https://h/", False),
    ]
    rows = spark.createDataFrame(cases, "c string, r string, want boolean").select("*", urls.within_root("c", "r").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_job_sites(spark):
    uuid = "0a1b2c3d-1111-2222-3333-444455556666"
    cases = [
        (f"https://jobs.ashbyhq.com/acme/{uuid}", ("ashby", "acme", uuid, False)), (f"https://jobs.ashbyhq.com/acme/{uuid}/application", ("ashby", "acme", uuid, True)),
        (f"https://jobs.lever.co/acme/{uuid}/apply", ("lever", "acme", uuid, True)), (f"https://jobs.lever.co/acme/{uuid}/application", None), ("https://boards.greenhouse.io/acme/jobs/12", ("greenhouse", "acme", "12", False)),
        ("https://boards.greenhouse.io/acme/jobs/x", None), ("https://jobs.lever.co/acme", ("lever", "acme", None, False)), ("https://jobs.lever.co/", None), ("https://jobs.lever.co:8443/acme", None), ("ftp://jobs.lever.co/acme", None), (None, None),
    ]
    rows = spark.createDataFrame([(u,) for u, _ in cases], "url string").select(ats.identify("url").alias("it")).collect()
    assert [tuple(r.it) if r.it else None for r in rows] == [want for _, want in cases]
    for url, want in cases:
        if url:
            assert documents.is_job_url(url) == bool(want and want[2] and not want[3])

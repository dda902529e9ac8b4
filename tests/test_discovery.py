import hashlib
import ipaddress
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.functions import ats, discovery, values
from siltstone.operators import fenced, frontier
from siltstone.plans import catalogue


def column(spark, texts, make):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in frame.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_global_addresses(spark):
    texts = ["8.8.8.8", "10.1.2.3", "192.0.0.9", "192.0.0.10", "192.0.0.8", "100.64.0.1", "100.128.0.1", "255.255.255.255", "1.2.3.4"]
    assert column(spark, texts, values.is_global_v4) == [ipaddress.ip_address(t).is_global for t in texts]
    odd = [None, "", "::1", "2001:4860::8888", "8.8.8", "8.8.8.256", "8.8.8.8.8", "8.8.8.x", "08.8.8.8", "99999999999.1.1.1", " 8.8.8.8"]
    assert column(spark, odd, values.is_global_v4) == [False] * len(odd)


def test_job_post_ids_escape_like_json(spark):
    slugs = ["acme", "é", 'a"b\\c', "x\ty\n\r\b\f", "\x01\x7f", "日本", "😀z", ""]
    want = [hashlib.sha256(json.dumps(["lever", s, "7"], separators=(",", ":")).encode()).hexdigest() for s in slugs]
    assert column(spark, slugs + [None], lambda t: ats.job_post_id(F.lit("lever"), t, F.lit("7"))) == [*want, None]


def test_broken_bytes_and_times(spark):
    assert spark.createDataFrame([(b"a\xffb\xc3\xa9",)], "b binary").select(values.utf8_text(F.col("b")).alias("t")).first().t == "a�bé"
    texts = ["2026-01-01T10:00:00Z", "2026-01-01 10:00:00.5+02:00", "2026-01-01T10:00:00", "2026-13-01T10:00:00Z", "10:00Z", "", None]
    assert column(spark, texts, values.zoned_time) == [True, True] + [False] * 5


def test_scope_and_final_hops(spark):
    posting = "https://jobs.lever.co/acme/0123abcd-0123-0123-0123-0123456789ab"
    rows = [(posting, 9), (posting + "/apply", 0), ("https://jobs.lever.co/acme", 3), ("https://jobs.lever.co/acme", 4), ("https://h.example/a/b", 3), ("https://h.example/a/b", 4), ("https://h.example/ab", 0), ("https://o.example/a/b", 0), (None, 0), ("::", 0)]
    got = spark.createDataFrame([(i, u, d, "https://h.example/a") for i, (u, d) in enumerate(rows)], "i int, u string, d int, r string").select("i", discovery.should_discover("u", "r", F.col("d"), 4).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [True, False, True, False, True, False, False, False, False, False]


def test_merged_lists(spark):
    frame = spark.createDataFrame([(["b", "a"], ["a", "c"]), (None, ["c"]), (None, None)], "a array<string>, b array<string>")
    told = lambda limit: [r.v for r in frame.select(discovery.merged(F.col("a"), F.col("b"), limit).alias("v")).collect()]
    assert told(None) == [["b", "a", "c"], ["c"], []] and told(2)[0] == ["b", "a"] and told(0) == [[], [], []]


def test_guarded_writes(spark):
    runs = spark.createDataFrame([("r1", "PENDING", None, None), ("r2", "PENDING", "x", "2"), ("r3", "FAILED", None, None)], "crawl_run_id string, status string, lock_token string, lock_expires_at string")
    asked = spark.createDataFrame([(r, "t") for r in ("r1", "r2", "r3", "none")], "crawl_run_id string, token string")
    got = {r.crawl_run_id: (r.error, r.lock_token) for r in fenced.acquire_lock(runs, asked, ["crawl_run_id"], "1", "9").collect()}
    assert got == {"r1": (None, "t"), "r2": (fenced.CONFLICT, "x"), "r3": (fenced.CONFLICT, None), "none": (fenced.CONFLICT, None)}
    after = fenced.applied(runs, fenced.acquire_lock(runs, asked, ["crawl_run_id"], "1", "9"), ["crawl_run_id"])
    assert {(r.crawl_run_id, r.lock_token, r.lock_expires_at) for r in after.collect()} == {("r1", "t", "9"), ("r2", "x", "2"), ("r3", None, None)}
    assert {r.error for r in fenced.release_lock(after, asked, ["crawl_run_id"]).where("crawl_run_id = 'r2'").collect()} == {fenced.CONFLICT}
    assert {r.crawl_run_id for r in fenced.deleted(runs, asked, ["crawl_run_id"], F.col("status") == "FAILED").collect()} == {"r1", "r2"}


def test_pages_of_a_run_that_share_their_url_are_written_apart(spark, tmp_path):
    pages = [(2, "https://h.example/a"), (42, "https://h.example/a"), (1, None), (41, None), (3, "https://h.example/b")]
    spark.createDataFrame([(*p, "") for p in pages], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    frame = catalogue.queries()["q42_fenced_writes"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = duck.execute(catalogue.oracle_sql()["q42_fenced_writes"])
    got = [tuple(r) for r in frame.select(*[d[0] for d in found.description]).collect()]
    assert sorted(got, key=repr) == sorted(found.fetchall(), key=repr) and len(got) == len(pages)


def test_a_run_starts_once(spark):
    asked = spark.createDataFrame([("s", "r", "https://h.example/")], "site_id string, crawl_run_id string, root_url string")
    none = spark.createDataFrame([], "site_id string, crawl_run_id string, canonical_url_hash string, created_at string")
    new = fenced.start_runs(none, none, none, asked, "1")
    assert [new[k].count() for k in ("sites", "runs", "pages")] == [1, 1, 1]
    again = fenced.start_runs(new["sites"], new["runs"], new["pages"], asked, "2")
    assert [again[k].count() for k in ("sites", "runs", "pages")] == [0, 0, 0]


def test_sitemap_pages(spark):
    found = spark.createDataFrame([("https://h.example/a/", u, i) for i, u in enumerate(["https://h.example/a/2", "https://h.example/a/1", "https://h.example/a/2", "https://o.example/a/3", "https://h.example/b", "https://h.example/a/x.pdf", "mailto:x"])], "root string, loc string, pos int")
    told = lambda limit: [(r.url[-1], r.rank) for r in frontier.sitemap_pages(found, limit).orderBy("rank").collect()]
    assert told(None) == [("2", 1), ("1", 2)] and told(1) == [("2", 1)] and told(0) == told(-1) == []


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch.root(Session())

from siltstone.operators import frontier, jobs, ledger, merge
from siltstone.sources.fetch import HttpSource
from siltstone.streaming import ledger_stream

PAGE = "crawl_run_id string, canonical_url_hash string, url string, status string, attempt_count int, children_attempt_count int, parsed_key string, worker_token string, lease_expires_at string, retry_after string, dispatch_pending boolean, dispatch_after string"


def page(h, status, attempts=0, children=0, parsed=None, lease=None, retry=None, pending=False, after=None):
    return ("r", h, "u" + h, status, attempts, children, parsed, None, lease, retry, pending, after)


def test_only_free_pages_of_active_runs_are_claimed(spark):
    pages = spark.createDataFrame([
        page("a", "QUEUED"), page("b", "CRAWLING_AND_PARSING", lease="3"), page("c", "CRAWLING_AND_PARSING", lease="7"), page("d", "QUEUED", retry="9"),
        page("e", "QUEUED", attempts=2), page("f", "CRAWLING_AND_PARSING", attempts=2, children=1, parsed="k", lease="1"), page("g", "COMPLETED"),
    ], PAGE)
    requests = spark.createDataFrame([("r", h, t, n) for h in "abcdefg" for t, n in (("late", 2), ("first", 1))], "crawl_run_id string, canonical_url_hash string, token string, at_ int")
    runs = spark.createDataFrame([("r", "PENDING")], "crawl_run_id string, status string")
    won = {r.canonical_url_hash: (r.worker_token, r.attempt_count, r.children_attempt_count) for r in ledger.claim(pages, requests, runs, "5", "8", 2).collect()}
    assert won == {"a": ("first", 1, 0), "b": ("first", 1, 0), "f": ("first", 2, 2)}
    ended = runs.selectExpr("crawl_run_id", "'FAILED' AS status")
    assert ledger.claim(pages, requests, ended, "5", "8", 2).count() == 0


def test_verdicts(spark):
    rows = [("x", "COMPLETED"), ("x", "FAILED"), ("y", "FAILED"), ("z", "COMPLETED"), ("z", "QUEUED")]
    got = {r.crawl_run_id: (r.status, r.incomplete) for r in ledger.verdict(spark.createDataFrame(rows, "crawl_run_id string, status string")).collect()}
    assert got == {"x": ("COMPLETED", True), "y": ("FAILED", True)}


def test_merges_can_be_repeated(spark):
    old = spark.createDataFrame([(1, "a", "c0"), (2, "b", "c0")], "k int, v string, created string")
    new = spark.createDataFrame([(2, "B", "c1"), (3, "C", "c1")], "k int, v string, created string")
    once = merge.upsert(old, new, ["k"], set_once=("created",))
    assert sorted(once.collect()) == [(1, "a", "c0"), (2, "B", "c0"), (3, "C", "c1")]
    assert sorted(merge.upsert(once, new, ["k"], set_once=("created",)).collect()) == sorted(once.collect())
    first = merge.insert_if_absent(old, new.union(new), ["k"], ["created"])
    assert sorted(first.collect()) == [(1, "a", "c0"), (2, "b", "c0"), (3, "C", "c1")]
    marks = spark.createDataFrame([("s", "5", "r5"), ("s", "4", "r4"), ("t", "1", "r1")], "site string, m string, run string")
    sites = spark.createDataFrame([("s", None, None), ("t", "3", "r3")], "site string, m string, run string")
    assert sorted(merge.raise_mark(sites, marks, "site", "m", "run").collect()) == [("s", "5", "r5"), ("t", "3", "r3")]


def test_frontier_bounds(spark):
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "a", 1), ("b", "e", 2), ("e", "f", 1)], "src string, dst string, pos int")
    roots = spark.createDataFrame([("a",)], "node string")
    walk = lambda **k: {r.node: r.depth for r in frontier.traverse(links, roots, **k).collect()}
    assert walk(max_depth=9) == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 2, "f": 3}
    assert walk(max_depth=1, per_page=2) == {"a": 0, "b": 1, "c": 1}
    assert walk(max_depth=9, per_run=3) == {"a": 0, "b": 1, "c": 1}


def test_only_links_of_the_frontier_are_grouped(spark, monkeypatch):
    rows = [(f"n{i}", f"n{i * 2 + k}", 5 - k) for i in range(1, 40) for k in range(4)] + [("n1", "n2", 9), (None, "n3", 1), ("n1", None, 0)]
    links, roots = spark.createDataFrame(rows, "src string, dst string, pos int"), spark.createDataFrame([("n1",), ("x",)], "node string")
    plans, write = [], frontier.written

    def noted(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(frontier, "written", noted)
    found = []
    for most in (frontier.BROADCAST_BYTES, 0):
        monkeypatch.setattr(frontier, "BROADCAST_BYTES", most)
        found.append(sorted(frontier.traverse(links, roots, 3, per_page=2).collect(), key=repr))
    levels = [p for p in plans if "Window" in p]
    assert levels and all("LeftSemi" in p[p.index("Aggregate [src"):] for p in levels)
    kept, walk, edge = {}, {"n1": 0, "x": 0}, {"n1", "x"}
    for src, dst, pos in sorted({(s, d, min(r[2] for r in rows if r[:2] == (s, d))) for s, d, _ in rows if s}, key=lambda r: (r[2], r[1] or "")):
        kept.setdefault(src, []).append(dst)
    for depth in (1, 2, 3):
        edge = {d for s in edge for d in kept.get(s, [])[:2]} - set(walk)
        walk |= dict.fromkeys(edge, depth)
    assert found[0] == found[1] == sorted(walk.items(), key=repr)


def test_payload_faults(spark):
    rows = [("lever", "1", '{"id":"1","text":"t","description":"","descriptionPlain":"p","categories":{"location":"x"}}'), ("lever", "2", '{"id":"1"}'), ("ashby", "1", "[]"), ("greenhouse", "7", '{"id":7,"title":" ","content":"c"}'), ("greenhouse", "7", None)]
    frame = spark.createDataFrame(rows, "provider string, job_id string, payload string")
    got = frame.select(jobs.normalise_payload(frame.provider, frame.job_id, frame.payload).alias("n")).collect()
    assert [r.n.fault for r in got] == [None, "other_job", "not_an_object", "no_title", "not_an_object"]
    assert tuple(got[0].n)[:3] == ("t", "p", "x")


def test_a_replayed_log_leaves_the_same_claims(spark):
    rows = spark.createDataFrame([(f"u{i % 5}", i) for i in range(40)], "url string, sent_at long")
    once = ledger_stream.claims(ledger_stream.message_stream(spark, rows), rows.limit(0), ["url"], ["sent_at"])
    twice = ledger_stream.claims(ledger_stream.message_stream(spark, rows.union(rows)), once, ["url"], ["sent_at"])
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 5


def test_http_source_keeps_one_byte_over_the_cap(tmp_path):
    class Response:
        status, headers = 200, {"Content-Type": "text/html"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self, n):
            return b"x" * min(n, 50)

    source = HttpSource({"urls": "http://h/a http://h/b", "cap": "10"})
    reader = source.reader(source.schema())
    reader.opener = lambda request, timeout: Response()
    assert [p.url for p in reader.partitions()] == ["http://h/a", "http://h/b"]
    assert list(reader.read(reader.partitions()[0])) == [("http://h/a", 200, "text/html", b"x" * 11)]

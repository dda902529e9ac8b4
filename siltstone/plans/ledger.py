"""Queries over crawl state: scans, versions, runs, claims, recovery, registration, merge writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import values
from siltstone.operators import ledger, merge
from siltstone.plans import sqlkit as K
from siltstone.plans.catalogue import query
from siltstone.tables import table

NOW = "2026-01-01T12:00:00+00:00"
EXPIRES = "2026-01-01T12:04:00+00:00"
MAX_ATTEMPTS = 2
P, R, V = K.duck("crawl_pages"), K.duck("crawl_runs"), K.duck("page_versions")


@query(
    "q11_latest_version",
    f"""SELECT site_id, url, run_no, event_id, crawled_at, raw_hash FROM (SELECT *, sha256(body) AS raw_hash, row_number() OVER (PARTITION BY site_id, url ORDER BY crawled_at DESC, run_no DESC, event_id DESC) AS n FROM {V}) WHERE n = 1""",
)
def q11_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.relation(spark, sf_dir, "page_versions").withColumn("raw_hash", F.sha2("body", 256))
    return merge.latest(rows.drop("body"), ["site_id", "url"], ["crawled_at", "run_no", "event_id"]).select("site_id", "url", "run_no", "event_id", "crawled_at", "raw_hash")


def change_flags(versions: DataFrame) -> DataFrame:
    """Whether each version differs from the one before it of the same URL; the first one does."""
    before = F.lag("body").over(W.partitionBy("site_id", "url").orderBy("crawled_at", "run_no", "event_id"))
    return versions.withColumn("changed", ~F.col("body").eqNullSafe(before))


_CHANGED = f"(SELECT *, body IS DISTINCT FROM lag(body) OVER (PARTITION BY site_id, url ORDER BY crawled_at, run_no, event_id) AS changed FROM {V})"


@query("q12_change_flags", f"SELECT event_id, site_id, url, changed FROM {_CHANGED}")
def q12_change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_flags(K.relation(spark, sf_dir, "page_versions")).select("event_id", "site_id", "url", "changed")


_SITES = "SELECT concat('site_', CAST(n AS VARCHAR(20))) AS site_id, CASE n % 3 WHEN 0 THEN TIMESTAMP '2024-01-15 00:00:00' WHEN 1 THEN TIMESTAMP '2099-01-01 00:00:00' END AS modified_at, CAST(-1 AS BIGINT) AS last_run FROM {src}"


@query(
    "q13_site_high_water",
    f"""WITH s AS ({_SITES.replace('{src}', '(SELECT range AS n FROM range(12))')}),
    m AS (SELECT site_id, max(crawled_at) AS m, max_by(run_no, (crawled_at, run_no)) AS r FROM {_CHANGED} WHERE changed GROUP BY site_id)
    SELECT s.site_id, CASE WHEN m.m IS NOT NULL AND (modified_at IS NULL OR m.m > modified_at) THEN m.m ELSE modified_at END AS modified_at,
    CASE WHEN m.m IS NOT NULL AND (modified_at IS NULL OR m.m > modified_at) THEN m.r ELSE last_run END AS last_run FROM s LEFT JOIN m USING (site_id)""",
)
def q13_site_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.sql(_SITES, src=spark.range(12).withColumnRenamed("id", "n")).withColumn("modified_at", F.col("modified_at").cast("timestamp_ntz"))
    marks = change_flags(K.relation(spark, sf_dir, "page_versions")).where("changed")
    marks = marks.select("site_id", F.col("crawled_at").cast("timestamp_ntz").alias("modified_at"), F.col("run_no").cast("long").alias("last_run"))
    return merge.raise_mark(sites, marks, "site_id", "modified_at", "last_run")


@query(
    "q14_run_progress",
    f"SELECT crawl_run_id, count(*) AS total, count_if(status = 'COMPLETED') AS completed, count_if(status = 'FAILED') AS failed, count_if(status NOT IN ('COMPLETED', 'FAILED')) AS pending FROM {P} GROUP BY 1",
)
def q14_run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.progress(K.relation(spark, sf_dir, "crawl_pages"))


@query(
    "q15_run_completion",
    f"""SELECT crawl_run_id, CASE WHEN count_if(status = 'COMPLETED') > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, count_if(status = 'COMPLETED') AS completed_page_count,
    count_if(status = 'FAILED') AS failed_page_count, count_if(status = 'FAILED') > 0 AS incomplete FROM (SELECT concat('run_', CAST(page_id % 400 AS VARCHAR)) AS crawl_run_id, status FROM {P})
    GROUP BY 1 HAVING bool_and(status IN ('COMPLETED', 'FAILED'))""",
)
def q15_run_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = K.relation(spark, sf_dir, "crawl_pages").withColumn("crawl_run_id", F.concat(F.lit("run_"), (F.col("page_id") % 400).cast("string")))
    return ledger.verdict(pages)


_MESSAGES = "SELECT page_id AS message_id, crawl_run_id, CASE WHEN page_id % 13 = 0 THEN 'missing' ELSE canonical_url_hash END AS canonical_url_hash, CASE WHEN page_id % 17 = 0 THEN 'https://else.example/' ELSE url END AS url FROM {src}"


@query(
    "q16_message_disposition",
    f"""SELECT m.message_id, CASE WHEN p.status IS NULL THEN 'drop_orphan' WHEN p.url <> m.url THEN 'mismatch' WHEN r.status IS NULL OR r.status IN ('COMPLETED','FAILED') THEN 'drop_run_ended'
    WHEN p.status IN ('COMPLETED','FAILED') THEN 'completion_check' ELSE 'work' END AS disposition
    FROM ({_MESSAGES.replace('{src}', P)}) m LEFT JOIN {P} p ON m.crawl_run_id = p.crawl_run_id AND m.canonical_url_hash = p.canonical_url_hash LEFT JOIN {R} r ON r.crawl_run_id = m.crawl_run_id""",
)
def q16_message_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = K.relation(spark, sf_dir, "crawl_pages")
    messages = spark.sql(_MESSAGES, src=pages)
    return ledger.disposition(messages, pages, K.relation(spark, sf_dir, "crawl_runs")).select("message_id", "disposition")


_EXHAUSTED = f"CASE WHEN parsed_key IS NOT NULL THEN coalesce(children_attempt_count, 0) >= 2 ELSE coalesce(attempt_count, 0) >= {MAX_ATTEMPTS} END"


@query(
    "q17_recovery_actions",
    f"""SELECT page_id, CASE WHEN status IN ('COMPLETED','FAILED') THEN 'skip' WHEN coalesce(lease_expires_at, '') > '{NOW}' THEN 'skip' WHEN coalesce(retry_after, '') > '{NOW}' THEN 'skip'
    WHEN {_EXHAUSTED} THEN 'fail' WHEN dispatch_pending OR coalesce(dispatch_after, '') <= '{NOW}' THEN 'dispatch' ELSE 'skip' END AS action FROM {P} p
    WHERE EXISTS (SELECT 1 FROM {R} r WHERE r.crawl_run_id = p.crawl_run_id AND r.status IN ('PENDING', 'CRAWLING_AND_PARSING'))""",
)
def q17_recovery_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = K.relation(spark, sf_dir, "crawl_runs").where(F.col("status").isin(ledger.PENDING, ledger.WORKING))
    pages = K.relation(spark, sf_dir, "crawl_pages").join(active.select("crawl_run_id"), "crawl_run_id", "left_semi")
    return pages.select("page_id", ledger.recovery_action(NOW, MAX_ATTEMPTS).alias("action"))


_REQUESTS = "SELECT crawl_run_id, canonical_url_hash, concat('w', CAST(k AS VARCHAR(20))) AS token, (page_id * 7 + k * 3) % 5 AS at_ FROM {src} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) AS three"


@query(
    "q18_claim_winner",
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY crawl_run_id, canonical_url_hash ORDER BY at_, token) AS n FROM ({_REQUESTS.replace('{src}', P + ' AS src')}))
    SELECT p.crawl_run_id, p.canonical_url_hash, f.token AS worker_token, attempt_count + CASE WHEN parsed_key IS NULL THEN 1 ELSE 0 END AS attempt_count,
    children_attempt_count + CASE WHEN parsed_key IS NULL THEN 0 ELSE 1 END AS children_attempt_count, '{EXPIRES}' AS lease_expires_at
    FROM {P} p JOIN f ON f.crawl_run_id = p.crawl_run_id AND f.canonical_url_hash = p.canonical_url_hash AND n = 1 JOIN {R} r ON r.crawl_run_id = p.crawl_run_id AND r.status IN ('PENDING','CRAWLING_AND_PARSING')
    WHERE (p.status = 'QUEUED' OR p.status = 'CRAWLING_AND_PARSING' AND coalesce(lease_expires_at, '') <= '{NOW}') AND coalesce(retry_after, '') <= '{NOW}' AND NOT {_EXHAUSTED}""",
)
def q18_claim_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = K.relation(spark, sf_dir, "crawl_pages")
    return ledger.claim(pages, spark.sql(_REQUESTS, src=pages), K.relation(spark, sf_dir, "crawl_runs"), NOW, EXPIRES, MAX_ATTEMPTS)


@query(
    "q19_retry_or_fail",
    f"""WITH e AS (SELECT *, CASE page_id % 9 WHEN 0 THEN 'UnsafeUrlError' WHEN 1 THEN 'TimeoutError' WHEN 2 THEN 'LockBusyError' WHEN 3 THEN 'PageNotFoundError' WHEN 4 THEN 'ResponseTooLargeError' WHEN 5 THEN 'RobotsDeniedError' WHEN 6 THEN 'UnsupportedContentTypeError' WHEN 7 THEN 'CrawlMessageError' END AS error_class, repeat('x', CAST(page_id % 1500 AS INT)) AS message FROM {P}),
    o AS (SELECT *, CASE WHEN error_class IS NULL THEN 'finish' WHEN error_class IN ('PageNotFoundError', 'ResponseTooLargeError', 'RobotsDeniedError', 'UnsafeUrlError', 'UnsupportedContentTypeError') OR {_EXHAUSTED} THEN 'fail' ELSE 'retry' END AS outcome FROM e)
    SELECT page_id, outcome, CASE outcome WHEN 'finish' THEN 'COMPLETED' WHEN 'fail' THEN 'FAILED' ELSE status END AS status, CASE WHEN error_class IS NOT NULL THEN substr(message, 1, 1000) END AS last_error,
    CASE WHEN outcome = 'retry' THEN '{NOW}' END AS lease_expires_at, CASE WHEN outcome = 'retry' AND error_class = 'LockBusyError' AND children_attempt_count > 0 THEN children_attempt_count - 1 ELSE children_attempt_count END AS children_attempt_count FROM o""",
)
def q19_retry_or_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE page_id % 9 WHEN 0 THEN 'UnsafeUrlError' WHEN 1 THEN 'TimeoutError' WHEN 2 THEN 'LockBusyError' WHEN 3 THEN 'PageNotFoundError' WHEN 4 THEN 'ResponseTooLargeError' WHEN 5 THEN 'RobotsDeniedError' WHEN 6 THEN 'UnsupportedContentTypeError' WHEN 7 THEN 'CrawlMessageError' END")
    rows = K.relation(spark, sf_dir, "crawl_pages").withColumn("error_class", kind).withColumn("message", F.when(kind.isNotNull(), F.repeat(F.lit("x"), (F.col("page_id") % 1500).cast("int"))))
    rows = rows.withColumn("outcome", ledger.outcome(F.col("error_class"), MAX_ATTEMPTS))
    done, again = ledger.finish(F.col("message")), ledger.retry(F.col("message"), NOW, EXPIRES, F.col("error_class") == "LockBusyError")
    retried = F.col("outcome") == "retry"
    return rows.select(
        "page_id", "outcome", F.when(retried, F.col("status")).otherwise(done["status"]).alias("status"), F.when(retried, again["last_error"]).otherwise(done["last_error"]).alias("last_error"),
        F.when(retried, again["lease_expires_at"]).otherwise(done["lease_expires_at"]).alias("lease_expires_at"), F.when(retried, again["children_attempt_count"]).otherwise(F.col("children_attempt_count")).alias("children_attempt_count"),
    )


_CANDIDATES = "SELECT concat('run_', CAST(l_suppkey % 40 AS VARCHAR(20))) AS crawl_run_id, {sha} AS canonical_url_hash, l_orderkey * 10 + l_linenumber AS pos FROM {src}"
CAPACITY = 60


@query(
    "q20_register_children",
    f"""WITH c AS ({_CANDIDATES.replace('{sha}', "sha256(CAST(l_partkey AS VARCHAR))").replace('{src}', 'lineitem')}),
    f AS (SELECT crawl_run_id, canonical_url_hash, min(pos) AS pos FROM c WHERE NOT EXISTS (SELECT 1 FROM {P} p WHERE p.crawl_run_id = c.crawl_run_id AND p.canonical_url_hash = c.canonical_url_hash) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY pos, canonical_url_hash) AS n FROM f),
    room AS (SELECT crawl_run_id, greatest(0, {CAPACITY} - count(DISTINCT canonical_url_hash)) AS room FROM {P} GROUP BY 1)
    SELECT crawl_run_id, canonical_url_hash, pos, CAST(n AS INTEGER) AS child_no, CAST((n - 1) // 50 AS INTEGER) AS batch_no FROM k LEFT JOIN room USING (crawl_run_id) WHERE n <= coalesce(room, {CAPACITY})""",
)
def q20_register_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _CANDIDATES.replace("{sha}", "sha2(CAST(l_partkey AS STRING), 256)")
    candidates = spark.sql(sql, src=table(spark, sf_dir, "lineitem"))
    return ledger.register_children(candidates, K.relation(spark, sf_dir, "crawl_pages"), CAPACITY)


@query(
    "q21_ordered_union",
    """WITH u AS (SELECT o_custkey, o_orderkey % 50 AS url, 0 AS side, o_orderkey AS pos FROM orders UNION ALL SELECT o_custkey, o_orderkey % 70, 1, o_orderkey FROM orders),
    f AS (SELECT o_custkey, url, min((side, pos)) AS at_ FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY at_) AS n FROM f)
    SELECT o_custkey, url, CAST(n AS INTEGER) AS n FROM k WHERE n <= 7""",
)
def q21_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = orders.select("o_custkey", (F.col("o_orderkey") % 50).alias("url"), F.col("o_orderkey").alias("pos"))
    second = orders.select("o_custkey", (F.col("o_orderkey") % 70).alias("url"), F.col("o_orderkey").alias("pos"))
    return ordered_union(first, second, "o_custkey", 7)


def ordered_union(primary: DataFrame, secondary: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Distinct urls of two lists (key, url, pos) in order, the primary list's first, up to a limit."""
    both = primary.withColumn("side", F.lit(0)).unionByName(secondary.withColumn("side", F.lit(1)))
    first = both.groupBy(key, "url").agg(F.min(F.struct("side", "pos")).alias("at"))
    ranked = first.select(key, "url", F.row_number().over(W.partitionBy(key).orderBy("at")).alias("n"))
    return ranked if limit is None else ranked.where(F.col("n") <= limit)


SCHEDULED = "2026-01-02T02:00:00-05:00"
_RUN_OF = "concat('crawl_', {sha})"


@query(
    "q22_nightly_refresh",
    f"""WITH s AS (SELECT DISTINCT site_id, 'https://' || site_id || '/' AS root_url FROM {P}), n AS (SELECT site_id, root_url, 'crawl_' || sha256('{SCHEDULED}:' || site_id) AS crawl_run_id FROM s),
    e AS (SELECT crawl_run_id, CASE strlen(site_id) % 3 WHEN 0 THEN 'PENDING' ELSE 'COMPLETED' END AS status FROM n WHERE strlen(site_id) % 3 <> 2)
    SELECT site_id, crawl_run_id, sha256(root_url) AS root_hash, CASE WHEN status IS NULL THEN 'create' WHEN status = 'PENDING' THEN 'resend' ELSE 'skip' END AS action,
    CAST(count(*) OVER () AS BIGINT) AS discovered, count_if(status IS NULL OR status = 'PENDING') OVER () AS queued FROM n LEFT JOIN e USING (crawl_run_id)""",
)
def q22_nightly_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = K.relation(spark, sf_dir, "crawl_pages").select("site_id").distinct().withColumn("root_url", F.concat(F.lit("https://"), "site_id", F.lit("/")))
    size = F.octet_length("site_id") % 3
    named = scheduled_runs(sites, SCHEDULED)
    existing = named.where(size != 2).select("crawl_run_id", F.when(size == 0, F.lit("PENDING")).otherwise(F.lit("COMPLETED")).alias("status"))
    out = refresh(sites, existing, SCHEDULED)
    counts = out.agg(F.count("*").alias("discovered"), F.count_if(F.col("action") != "skip").alias("queued"))
    return out.select("site_id", "crawl_run_id", F.sha2("root_url", 256).alias("root_hash"), "action").join(F.broadcast(counts))


def scheduled_runs(sites: DataFrame, scheduled: str) -> DataFrame:
    """Each site's run id for one scheduled time: the same for the same text of the time."""
    return sites.withColumn("crawl_run_id", F.concat(F.lit("crawl_"), F.sha2(F.concat(F.lit(scheduled + ":"), "site_id"), 256)))


def refresh(sites: DataFrame, runs: DataFrame, scheduled: str) -> DataFrame:
    """What a scheduled refresh does with each site: create a run, resend a pending one, or skip."""
    joined = scheduled_runs(sites, scheduled).join(runs, "crawl_run_id", "left")
    return joined.withColumn("action", F.when(F.col("status").isNull(), F.lit("create")).when(F.col("status") == ledger.PENDING, F.lit("resend")).otherwise(F.lit("skip")))


@query(
    "q25_object_keys",
    f"""WITH k AS (SELECT page_id, canonical_url_hash AS h, sha256('body' || (page_id % 20)) AS raw FROM {P}), n AS (SELECT page_id, 'sites/' || h || '/raw/' || raw || '.html' AS raw_key, 'sites/' || h || '/ats/' || sha256('null') || '.json' AS ats_key,
    'sites/' || h || '/parsed/' || raw || '.json' AS parsed_key FROM k) SELECT *, NOT page_id % 3 = 0 AS missing FROM n""",
)
def q25_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = K.relation(spark, sf_dir, "crawl_pages").select("page_id", F.col("canonical_url_hash").alias("h"), F.sha2(F.concat(F.lit("body"), (F.col("page_id") % 20).cast("string")), 256).alias("raw"))
    keyed = pages.select("page_id", F.concat_ws("/", F.lit("sites"), "h", F.lit("raw"), F.concat("raw", F.lit(".html"))).alias("raw_key"),
        F.concat_ws("/", F.lit("sites"), "h", F.lit("ats"), F.concat(F.sha2(F.lit("null"), 256), F.lit(".json"))).alias("ats_key"),
        F.concat_ws("/", F.lit("sites"), "h", F.lit("parsed"), F.concat("raw", F.lit(".json"))).alias("parsed_key"))
    stored = keyed.where("page_id % 3 = 0").select("raw_key").distinct().withColumn("there", F.lit(True))
    return keyed.join(stored, "raw_key", "left").select("page_id", "raw_key", "ats_key", "parsed_key", F.col("there").isNull().alias("missing"))


@query(
    "q26_snapshot_merge",
    """WITH s AS (SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS BIGINT) AS n, 'old' AS created FROM customer WHERE c_custkey % 3 <> 0),
    r AS (SELECT c_custkey AS k, c_mktsegment AS name, CAST(c_custkey AS BIGINT) AS n, 'new' AS created FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(s.k, r.k) AS k, CASE WHEN r.k IS NOT NULL THEN r.name ELSE s.name END AS name, CASE WHEN r.k IS NOT NULL THEN r.n ELSE s.n END AS n, coalesce(s.created, r.created) AS created FROM s FULL JOIN r ON s.k = r.k""",
)
def q26_snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "c_name AS name", "CAST(c_nationkey AS BIGINT) AS n", "'old' AS created")
    new = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_mktsegment AS name", "CAST(c_custkey AS BIGINT) AS n", "'new' AS created")
    return merge.upsert(old, new, ["k"], set_once=("created",))


@query(
    "q27_outbox",
    f"""SELECT c.page_id, c.parent_url, '{{"action":"crawl_url","payload":{{"url":"' || c.url || '","depth":' || c.depth || '}}}}' AS body, 30 * (c.page_id % 3) AS delay FROM {P} c
    WHERE c.dispatch_pending AND c.parent_url IS NOT NULL AND c.status NOT IN ('COMPLETED', 'FAILED')""",
)
def q27_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.relation(spark, sf_dir, "crawl_pages").where("dispatch_pending AND parent_url IS NOT NULL").where(~F.col("status").isin(*ledger.TERMINAL))
    body = F.to_json(F.struct(F.lit("crawl_url").alias("action"), F.struct("url", "depth").alias("payload")))
    return rows.select("page_id", "parent_url", body.alias("body"), (30 * (F.col("page_id") % 3)).alias("delay"))




_IP = """CASE l_orderkey % 97 WHEN 5 THEN '192.0.0.9' WHEN 6 THEN NULL WHEN 7 THEN '2001:4860::1' WHEN 8 THEN '8.8.8' WHEN 9 THEN '8.8.8.256' WHEN 11 THEN '192.0.0.10' WHEN 12 THEN '192.0.0.11'
  ELSE concat(CAST({n} % 256 AS VARCHAR(20)), '.', CAST(CAST(floor({n} / 7) AS INT) % 256 AS VARCHAR(20)), '.', CAST({n} % 3 AS VARCHAR(20)), '.', CAST({n} % 251 AS VARCHAR(20))) END""".replace("{n}", "(l_orderkey * 37 + l_linenumber)")
_PARTS = [f"TRY_CAST(string_split(ip, '.')[{k}] AS BIGINT)" for k in range(1, 5)]


@query(
    "q28_public_ipv4",
    f"""WITH i AS (SELECT l_orderkey % 500 AS host, {_IP} AS ip FROM lineitem),
    v AS (SELECT host, ip, CASE WHEN len(string_split(ip, '.')) = 4 AND {' AND '.join(f'{p} BETWEEN 0 AND 255' for p in _PARTS)} THEN {_PARTS[0]} * 16777216 + {_PARTS[1]} * 65536 + {_PARTS[2]} * 256 + {_PARTS[3]} END AS v FROM i)
    SELECT host, count(*) AS addresses, bool_and(CASE WHEN v IS NULL THEN false WHEN ip IN ('192.0.0.9', '192.0.0.10') THEN true ELSE NOT ({' OR '.join(f'v BETWEEN {a} AND {b}' for a, b in values.private_ranges())}) END) AS allowed FROM v GROUP BY host""",
)
def q28_public_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT l_orderkey % 500 AS host, {_IP} AS ip FROM {{src}}", src=table(spark, sf_dir, "lineitem"))
    return rows.groupBy("host").agg(F.count("*").alias("addresses"), F.bool_and(values.is_global_v4(F.col("ip"))).alias("allowed"))


@query(
    "q31_point_and_partition_scans",
    f"""SELECT 'page' AS scan, count(*) AS n FROM {P} WHERE crawl_run_id = 'run_3' AND canonical_url_hash = sha256((SELECT min(url) FROM pages WHERE page_id % 40 = 3)) UNION ALL SELECT 'run', count(*) FROM {P} WHERE crawl_run_id = 'run_3'
    UNION ALL SELECT 'active', count(*) FROM {R} WHERE status IN ('PENDING', 'CRAWLING_AND_PARSING') UNION ALL SELECT 'sites', count(DISTINCT site_id) FROM {P} UNION ALL SELECT 'site', count(*) FROM {R} WHERE site_id = 'site_1'
    UNION ALL SELECT 'filter', count(*) FROM {P} WHERE depth = 2""",
)
def q31_point_and_partition_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, runs = K.relation(spark, sf_dir, "crawl_pages"), K.relation(spark, sf_dir, "crawl_runs")
    one = table(spark, sf_dir, "pages").where("page_id % 40 = 3").agg(F.sha2(F.min("url"), 256).alias("canonical_url_hash"))
    told = {
        "page": pages.where("crawl_run_id = 'run_3'").join(F.broadcast(one), "canonical_url_hash", "left_semi"), "run": pages.where("crawl_run_id = 'run_3'"),
        "active": runs.where(F.col("status").isin(ledger.PENDING, ledger.WORKING)), "sites": pages.select("site_id").distinct(), "site": runs.where("site_id = 'site_1'"), "filter": pages.where("depth = 2"),
    }
    out = None
    for name, rows in told.items():
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("scan"), "n")
        out = counted if out is None else out.union(counted)
    return out


@query(
    "q33_value_marshalling",
    """SELECT o_orderkey, upper(o_orderstatus || 'x') AS enum_value, CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,18)) AS number, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S+00:00') AS day,
    strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 240 SECOND, '%Y-%m-%dT%H:%M:%S+00:00') AS lease_end, '{"k":' || o_orderkey || '}' AS body FROM orders""",
)
def q33_value_marshalling(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.upper(F.concat("o_orderstatus", F.lit("x"))).alias("enum_value"), F.col("o_totalprice").cast("string").cast("decimal(38,18)").alias("number"),
        F.date_format(day, iso).alias("day"), F.date_format(day + F.expr("INTERVAL 240 SECOND"), iso).alias("lease_end"), F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("body"),
    )


@query(
    "q35_transaction_error_class",
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ['None', 'ConditionalCheckFailed'] WHEN 1 THEN ['None'] WHEN 2 THEN ['ThrottlingError', 'ConditionalCheckFailed'] WHEN 3 THEN ['ConditionalCheckFailed'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM customer)
    SELECT c_custkey, CASE WHEN len(list_filter(codes, lambda x: x NOT IN ('None', 'ConditionalCheckFailed'))) = 0 AND list_contains(codes, 'ConditionalCheckFailed') THEN 'condition' ELSE 'operational' END AS kind FROM t""",
)
def q35_transaction_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.expr("CASE c_custkey % 5 WHEN 0 THEN array('None', 'ConditionalCheckFailed') WHEN 1 THEN array('None') WHEN 2 THEN array('ThrottlingError', 'ConditionalCheckFailed') WHEN 3 THEN array('ConditionalCheckFailed') ELSE CAST(array() AS ARRAY<STRING>) END")
    only = (F.size(F.array_except(codes, F.array(F.lit("None"), F.lit("ConditionalCheckFailed")))) == 0) & F.array_contains(codes, "ConditionalCheckFailed")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(only, F.lit("condition")).otherwise(F.lit("operational")).alias("kind"))


@query(
    "q37_missing_objects",
    "SELECT 'raw/' || p_partkey AS object_key FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 1 AND l_orderkey % 4 = 0)",
)
def q37_missing_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = table(spark, sf_dir, "part").select(F.concat(F.lit("raw/"), F.col("p_partkey").cast("string")).alias("object_key"))
    there = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_orderkey % 4 = 0").select(F.concat(F.lit("raw/"), F.col("l_partkey").cast("string")).alias("object_key"))
    return needed.join(there, "object_key", "left_anti")


@query(
    "q39_positive_limits",
    """WITH l AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' 5 ' WHEN 2 THEN '0' ELSE 'x' END AS setting FROM customer)
    SELECT c_custkey, CASE WHEN trim(setting) = '' THEN NULL ELSE TRY_CAST(trim(setting) AS INTEGER) END AS limit_value, trim(setting) <> '' AND coalesce(TRY_CAST(trim(setting) AS INTEGER), 0) <= 0 AS rejected FROM l""",
)
def q39_positive_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    setting = F.trim(F.expr("CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' 5 ' WHEN 2 THEN '0' ELSE 'x' END"))
    number = F.when(setting != "", F.expr("1")).isNotNull()
    value = F.when(setting.rlike("^[0-9]+$"), setting.try_cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("limit_value"), (number & (F.coalesce(value, F.lit(0)) <= 0)).alias("rejected"))

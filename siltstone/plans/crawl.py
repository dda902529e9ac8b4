"""Queries over pages: child links, URL identity, guards, metadata, ATS recognition, content dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions import ats, html, urls
from siltstone.plans import sqlkit as K
from siltstone.plans.catalogue import query
from siltstone.tables import table

MAX_DEPTH, PER_PAGE = 4, 5

_ENTITIES = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def _unescaped(x: str) -> str:
    return _ENTITIES.format(x=x)


def child_links(pages: DataFrame, per_page: int | None = PER_PAGE) -> DataFrame:
    """Distinct accepted links of each page: the first `per_page` in document order, then sorted."""
    rows = pages.select("page_id", "url", F.concat(urls.origin("url"), F.lit("/")).alias("root"), F.posexplode(html.anchors(F.col("html"))).alias("pos", "a"))
    rows = rows.where(~html.nofollow(F.col("a.rel"))).withColumn("target", urls.resolve("url", F.col("a.href")))
    rows = rows.withColumn("child_url", urls.canonicalise("target")).where("child_url IS NOT NULL")
    rows = rows.where(urls.within_root("child_url", "root"))
    first = rows.groupBy("page_id", "url", "child_url").agg(F.min("pos").alias("pos"))
    if per_page is not None:
        # Ranks within a page, whose links its markup bounds.
        first = first.withColumn("seen", F.row_number().over(W.partitionBy("page_id", "url").orderBy("pos"))).where(F.col("seen") <= per_page)
    return first.withColumn("child_rank", F.row_number().over(W.partitionBy("page_id", "url").orderBy("child_url")))


_Q01 = f"""
WITH links AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS org, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)),
t AS (SELECT page_id, url, pos, org || {_unescaped('href')} AS target FROM links),
p AS (SELECT page_id, url, pos, {K.canonical('')} AS child_url, path FROM {K.parts('t', 'target')}),
f AS (SELECT page_id, url, child_url, min(pos) AS pos FROM p WHERE child_url IS NOT NULL AND rtrim(path, '/') <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS seen FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY child_url) AS child_rank FROM k WHERE seen <= {PER_PAGE})
SELECT page_id, canonical_url, sha256(canonical_url) AS canonical_url_hash, child_url, sha256(child_url) AS child_url_hash, CAST(child_rank AS INTEGER) AS child_rank
FROM (SELECT r.*, {K.canonical('u')} AS canonical_url FROM {K.parts('r', 'url', 'u')} r)"""


@query("q01_child_links", _Q01)
def q01_child_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = child_links(table(spark, sf_dir, "pages")).withColumn("canonical_url", urls.canonicalise("url"))
    return out.select("page_id", "canonical_url", urls.url_hash("canonical_url").alias("canonical_url_hash"), "child_url", urls.url_hash("child_url").alias("child_url_hash"), "child_rank")


@query(
    "q02_canonical_url_hash",
    f"""SELECT page_id, {K.normal()} AS normal_url, {K.canonical()} AS canonical_url, sha256({K.canonical()}) AS url_hash,
    host || '#' || sha256({K.canonical()}) AS site_url_key FROM {K.parts("(SELECT page_id, url FROM pages UNION ALL SELECT -page_id, upper(substr(url, 1, 12)) || substr(url, 13) || CASE page_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '#x' ELSE '' END FROM pages)", "url")}""",
)
def q02_canonical_url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    odd = pages.selectExpr("-page_id AS page_id", "concat(upper(substr(url, 1, 12)), substr(url, 13), CASE page_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '#x' ELSE '' END) AS url")
    rows = pages.union(odd).withColumn("normal_url", urls.normalise("url")).withColumn("canonical_url", urls.canonicalise("url"))
    return rows.select("page_id", "normal_url", "canonical_url", urls.url_hash("canonical_url").alias("url_hash"), F.concat_ws("#", urls.host("url"), urls.url_hash("canonical_url")).alias("site_url_key")).withColumn(
        "site_url_key", F.when(F.col("url_hash").isNotNull(), F.col("site_url_key"))
    )


_GUARDED = """SELECT c_custkey, concat(CASE c_custkey % 8 WHEN 0 THEN 'ftp://' WHEN 1 THEN 'http://user:pw@' WHEN 2 THEN 'https://LOCALHOST:80/' WHEN 3 THEN 'http://a.localhost/' WHEN 4 THEN 'https:///' ELSE 'https://' END,
  'host', CAST(c_custkey % 17 AS VARCHAR(20)), '.example.com', CASE c_custkey % 5 WHEN 0 THEN ':99999' WHEN 1 THEN ':8080' ELSE '' END, '/p/', CAST(c_custkey AS VARCHAR(20))) AS url, c_custkey % 6 AS kind FROM customer"""


@query(
    "q03_url_guard_reasons",
    f"""WITH p AS (SELECT * FROM {K.parts(f"({_GUARDED})", "url")})
    SELECT c_custkey, CASE WHEN scheme NOT IN ('http','https') OR host = '' THEN 'scheme_or_host' WHEN regexp_matches(regexp_extract(auth, '^(.*)@', 1), '[^:]') THEN 'credentials'
      WHEN host = 'localhost' OR host LIKE '%.localhost' THEN 'localhost' END AS shape_fault,
    CASE kind WHEN 0 THEN 'action' WHEN 1 THEN 'site_id' WHEN 2 THEN 'depth' WHEN 3 THEN 'hash_form' WHEN 4 THEN 'hash' END AS message_fault FROM p""",
)
def q03_url_guard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_GUARDED.replace("FROM customer", "FROM {src}"), src=table(spark, sf_dir, "customer"))
    digest = F.when(F.col("kind") == 3, F.lit("XYZ")).when(F.col("kind") == 4, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("url", 256))
    payload = F.struct(
        F.when(F.col("kind") == 1, F.lit("  ")).otherwise(F.lit("site")).alias("site_id"), F.lit("run").alias("crawl_run_id"), F.lit("https://r.example/").alias("root_url"), F.col("url"),
        digest.alias("canonical_url_hash"), F.when(F.col("kind") == 2, F.lit(-1)).otherwise(F.lit(3)).alias("depth"),
    )
    message = F.to_json(F.struct(F.when(F.col("kind") == 0, F.lit("other")).otherwise(F.lit("crawl_url")).alias("action"), payload.alias("payload")))
    return rows.select("c_custkey", urls.shape_fault("url").alias("shape_fault"), message_fault(message).alias("message_fault"))


MESSAGE = "action string, payload struct<site_id: string, crawl_run_id: string, root_url: string, url: string, canonical_url_hash: string, depth: string>"


def message_fault(message):
    """The first rule that a crawl message breaks, or null."""
    m = F.from_json(message, MESSAGE)
    p = m["payload"]
    blank = lambda name: F.coalesce(F.trim(p[name]), F.lit("")) == ""
    fault = F.when(F.coalesce(m["action"] != "crawl_url", F.lit(True)), F.lit("action")).when(p.isNull(), F.lit("payload"))
    for name in ("site_id", "crawl_run_id", "root_url", "url", "canonical_url_hash"):
        fault = fault.when(blank(name), F.lit(name))
    fault = fault.when(~F.coalesce(p["depth"].rlike("^[0-9]+$"), F.lit(False)), F.lit("depth"))
    fault = fault.when(~F.trim(p["canonical_url_hash"]).rlike("^[0-9a-f]{64}$"), F.lit("hash_form"))
    return fault.when(F.sha2(F.trim(p["url"]), 256) != F.trim(p["canonical_url_hash"]), F.lit("hash"))


_CLEAN = "nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def _clean(x: str) -> str:
    return _CLEAN.format(x=x)


@query(
    "q04_document_metadata",
    f"""SELECT page_id, {_clean(_unescaped("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))} AS title, {_clean("regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1)")} AS language,
    CAST(NULL AS VARCHAR) AS description, sha256(html) AS raw_html_hash, strlen(html) AS content_length FROM pages""",
)
def q04_document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", html.title(h).alias("title"), html.language(h).alias("language"), html.description(h).alias("description"), F.sha2("html", 256).alias("raw_html_hash"),
        F.octet_length("html").cast("long").alias("content_length"),
    )


@query(
    "q05_headings",
    f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, lower(substr(h, 2, 2)) AS level, {_clean(_unescaped("regexp_replace(h, '<[^>]*>', '', 'g')"))} AS text FROM
    (SELECT page_id, unnest(range(len(hs))) AS pos, unnest(hs) AS h FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>') AS hs FROM pages))""",
)
def q05_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.headings(F.col("html"))).alias("pos", "h"))
    return rows.select("page_id", "pos", "h.level", "h.text")


@query(
    "q06_ats_identify",
    f"SELECT p_partkey, s.provider AS provider, s.employer AS employer, s.job_id AS job_id, s.is_form AS is_form FROM (SELECT p_partkey, {K.identified()} AS s FROM {K.parts(K.duck('ats_urls'), 'url')})",
)
def q06_ats_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.relation(spark, sf_dir, "ats_urls").select("p_partkey", ats.identify("url").alias("s"))
    return rows.select("p_partkey", "s.provider", "s.employer", "s.job_id", "s.is_form")


@query(
    "q07_ats_endpoint",
    f"""SELECT p_partkey, CASE WHEN s.job_id IS NULL OR s.is_form THEN NULL WHEN s.provider = 'ashby' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || url_encode(s.employer)
      WHEN s.provider = 'greenhouse' AND host NOT LIKE '%.eu.greenhouse.io%' THEN 'https://boards-api.greenhouse.io/v1/boards/' || url_encode(s.employer) || '/jobs/' || url_encode(s.job_id)
      WHEN s.provider = 'lever' THEN CASE WHEN host = 'jobs.eu.lever.co' THEN 'https://api.eu.lever.co' ELSE 'https://api.lever.co' END || '/v0/postings/' || url_encode(s.employer) || '/' || url_encode(s.job_id) || '?mode=json' END AS endpoint,
      url_encode(p_name || ' ~*/é') AS encoded
    FROM (SELECT p_partkey, p_name, host, {K.identified()} AS s FROM {K.parts(K.duck('ats_urls'), 'url')})""",
)
def q07_ats_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.relation(spark, sf_dir, "ats_urls")
    return rows.select("p_partkey", ats.endpoint("url").alias("endpoint"), ats.percent_encode(F.concat("p_name", F.lit(" ~*/é"))).alias("encoded"))


@query(
    "q29_script_url_fallback",
    f"""WITH s AS (SELECT p_partkey, unnest(regexp_extract_all('var x = {{"u":"' || url || '"}}; go(<' || url || '/apply>)', 'https?://[^\\s"<>\\\\]+')) AS link FROM {K.duck('ats_urls')}),
    i AS (SELECT p_partkey, link, {K.identified()} AS s FROM {K.parts('s', 'link')})
    SELECT DISTINCT p_partkey, link FROM i WHERE s.job_id IS NOT NULL AND NOT s.is_form""",
)
def q29_script_url_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.concat(F.lit('var x = {"u":"'), "url", F.lit('"}; go(<'), "url", F.lit("/apply>)"))
    rows = K.relation(spark, sf_dir, "ats_urls").select("p_partkey", F.explode(script_job_urls(script)).alias("link"))
    return rows


def script_job_urls(script):
    """Distinct job pages among the URLs in a script that is not JSON."""
    found = F.array_distinct(F.regexp_extract_all(script, F.lit(r'https?://[^\s"<>\\]+'), F.lit(0)))
    return F.filter(found, lambda u: F.coalesce(urls.let(ats.identify(u), lambda s: s["job_id"].isNotNull() & ~s["is_form"]), F.lit(False)))


#: Content types that are parsed (fixed values).
HTML_TYPES, MARKDOWN_TYPES = ("application/xhtml+xml", "text/html"), ("text/markdown", "text/x-markdown")


@query(
    "q30_content_dispatch",
    f"""SELECT page_id, CASE WHEN strlen(html) > 2500 THEN 'too_large' WHEN ct IN ('application/xhtml+xml', 'text/html') THEN 'html' WHEN ct IN ('text/markdown', 'text/x-markdown') THEN 'markdown' ELSE 'unsupported' END AS handler,
    {K.suffix("regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)")} IN ({K.SUFFIXES}) AS skipped
    FROM (SELECT page_id, html, url || CASE page_id % 3 WHEN 0 THEN '/x.tar.gz' WHEN 1 THEN '/.css' ELSE '' END AS url, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'image/png' ELSE 'text/x-markdown' END AS ct FROM pages)""",
)
def q30_content_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "html", "concat(url, CASE page_id % 3 WHEN 0 THEN '/x.tar.gz' WHEN 1 THEN '/.css' ELSE '' END) AS url",
        "CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'image/png' ELSE 'text/x-markdown' END AS ct",
    )
    handler = F.when(F.octet_length("html") > 2500, F.lit("too_large")).when(F.col("ct").isin(*HTML_TYPES), F.lit("html")).when(F.col("ct").isin(*MARKDOWN_TYPES), F.lit("markdown")).otherwise(F.lit("unsupported"))
    return rows.select("page_id", handler.alias("handler"), urls.suffix(urls.part("url", 3)).isin(*urls.SKIPPED_SUFFIXES).alias("skipped"))


@query(
    "q32_redirect_guard",
    f"""WITH r AS (SELECT c_custkey, 'https://site' || (c_custkey % 7) || '.example/a' AS src, CASE c_custkey % 4 WHEN 0 THEN 'https://site' || (c_custkey % 7) || '.example/b' WHEN 1 THEN 'http://localhost/x'
      WHEN 2 THEN 'https://u@other.example/' ELSE 'https://other.example/' END AS dst FROM customer)
    SELECT c_custkey, CASE WHEN host = 'localhost' THEN 'refused' WHEN regexp_matches(regexp_extract(auth, '^(.*)@', 1), '[^:]') THEN 'refused' ELSE 'followed' END AS page_rule, 'refused' AS api_rule,
    host = regexp_extract(src, '//([^/]*)', 1) AS same_origin FROM {K.parts('r', 'dst')}""",
)
def q32_redirect_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat('https://site', c_custkey % 7, '.example/a') AS src",
        "CASE c_custkey % 4 WHEN 0 THEN concat('https://site', c_custkey % 7, '.example/b') WHEN 1 THEN 'http://localhost/x' WHEN 2 THEN 'https://u@other.example/' ELSE 'https://other.example/' END AS dst",
    )
    rule = F.when(urls.shape_fault("dst").isNull(), F.lit("followed")).otherwise(F.lit("refused"))
    return rows.select("c_custkey", rule.alias("page_rule"), F.lit("refused").alias("api_rule"), urls.same_origin("dst", "src").alias("same_origin"))


@query(
    "q36_nofollow_and_base",
    """SELECT c_custkey, c_custkey % 3 = 0 AS nofollow, CASE c_custkey % 4 WHEN 0 THEN 'https://a.example/sub/' WHEN 1 THEN 'https://b.example/' END AS base_url,
    CASE WHEN c_custkey % 4 = 0 THEN 'https://a.example/sub/' ELSE 'https://a.example/' END || 'p' || c_custkey AS target FROM customer""",
)
def q36_nofollow_and_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = """concat(CASE c_custkey % 4 WHEN 0 THEN '<base href="/sub/">' WHEN 1 THEN '<base href="https://b.example/">' ELSE '' END, '<a class="k" href="p', c_custkey, '"', CASE WHEN c_custkey % 3 = 0 THEN ' rel="noopener NoFollow"' ELSE ' rel="nofollows"' END, '>x</a>')"""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{markup} AS html", "'https://a.example/' AS url")
    rows = rows.withColumn("base_url", F.when(html.base_href(F.col("html")).isNotNull(), urls.resolve("url", html.base_href(F.col("html")))))
    within = urls.within_root("base_url", "url", include_root=True)
    rows = rows.withColumn("used", F.when(within, F.col("base_url")).otherwise(F.col("url"))).withColumn("a", F.get(html.anchors(F.col("html")), F.lit(0)))
    return rows.select("c_custkey", html.nofollow(F.col("a.rel")).alias("nofollow"), "base_url", urls.resolve("used", F.col("a.href")).alias("target"))

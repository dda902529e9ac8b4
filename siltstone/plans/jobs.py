"""Queries over job posts, boards, API payloads, the frontier and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import ats
from siltstone.operators import frontier, jobs
from siltstone.plans import sqlkit as K
from siltstone.plans.catalogue import query
from siltstone.tables import table

_PAYLOADS = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' ELSE 'lever' END AS provider, CAST(p_partkey AS VARCHAR(20)) AS job_id,
CASE WHEN p_partkey % 17 = 0 THEN '[1]' ELSE concat('{"id":', CASE WHEN p_partkey % 3 = 2 THEN concat('"', CAST(p_partkey AS VARCHAR(20)), '"') ELSE CAST(p_partkey + CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) END,
  ',"title":"', CASE WHEN p_partkey % 23 = 0 THEN '  ' ELSE p_name END, '","text":"', p_name, '","content":"', p_type, '","description":"', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END,
  '","descriptionPlain":"plain ', p_type, '","descriptionHtml":"', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END, '","location":', CASE WHEN p_partkey % 2 = 0 THEN '{"name":"Oslo"}' ELSE '"Rome"' END, ',"categories":{"location":"Bern"}}') END AS payload
FROM part"""


@query(
    "q08_job_normalise",
    f"""WITH p AS ({_PAYLOADS}), j AS (SELECT *, CASE WHEN provider = 'lever' THEN json_extract_string(payload, '$.text') ELSE json_extract_string(payload, '$.title') END AS title,
      CASE provider WHEN 'ashby' THEN coalesce(nullif(json_extract_string(payload, '$.descriptionHtml'), ''), json_extract_string(payload, '$.descriptionPlain')) WHEN 'greenhouse' THEN json_extract_string(payload, '$.content')
        ELSE coalesce(nullif(json_extract_string(payload, '$.description'), ''), json_extract_string(payload, '$.descriptionPlain')) END AS description,
      CASE WHEN provider = 'lever' THEN json_extract_string(payload, '$.categories.location') WHEN payload LIKE '[%' THEN NULL ELSE coalesce(json_extract_string(payload, '$.location.name'), json_extract_string(payload, '$.location')) END AS location FROM p)
    SELECT p_partkey, title, description, location, CASE WHEN payload NOT LIKE '{{%' THEN 'not_an_object' WHEN provider <> 'ashby' AND json_extract_string(payload, '$.id') IS DISTINCT FROM job_id THEN 'other_job'
      WHEN trim(coalesce(title, '')) = '' THEN 'no_title' WHEN trim(coalesce(description, '')) = '' THEN 'no_description' END AS fault,
      CASE WHEN strlen(description) <= 200000 THEN description END AS inline_description, CASE WHEN strlen(description) > 200000 THEN 'key' END AS description_key FROM j""",
)
def q08_job_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("siltstone_part")
    rows = spark.sql(_PAYLOADS.replace("FROM part", "FROM siltstone_part"))
    rows = rows.withColumn("n", jobs.normalise_payload(F.col("provider"), F.col("job_id"), F.col("payload")))
    placed = jobs.placed_description(F.col("n.description"), F.lit("key"))
    return rows.select("p_partkey", "n.title", "n.description", "n.location", "n.fault", placed["description"].alias("inline_description"), placed["description_key"].alias("description_key"))


_SEEN = "SELECT concat('emp', CAST(l_suppkey % 5 AS VARCHAR(20))) AS employer_slug, CAST(l_partkey % 300 AS VARCHAR(20)) AS employer_job_id, 'lever' AS ats_provider, concat('https://x.example/', CAST(l_orderkey AS VARCHAR(20)), '/', CAST(l_linenumber AS VARCHAR(20))) AS url, l_shipdate AS created_at FROM {src}"


@query(
    "q09_job_posts_first_wins",
    f"""WITH s AS ({_SEEN.replace('{src}', 'lineitem')}), k AS (SELECT *, row_number() OVER (PARTITION BY employer_slug, employer_job_id ORDER BY created_at, url) AS n FROM s)
    SELECT sha256('["lever","' || employer_slug || '","' || employer_job_id || '"]') AS job_post_id, employer_slug, employer_job_id, ats_provider, url, created_at FROM k WHERE n = 1""",
)
def q09_job_posts_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.first_jobs(spark.sql(_SEEN, src=table(spark, sf_dir, "lineitem")))


@query(
    "q10_board_links_and_counts",
    """WITH l AS (SELECT l_suppkey AS job_board_id, l_partkey AS job_post_id, min(l_shipdate) AS created_at, max(l_shipdate) AS last_seen_at, max_by(l_orderkey, (l_shipdate, l_orderkey)) AS last_seen_run FROM lineitem GROUP BY 1, 2)
    SELECT *, count(*) OVER (PARTITION BY job_board_id) AS num_job_posts FROM l""",
)
def q10_board_links_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job_board_id"), F.col("l_partkey").alias("job_post_id"), F.col("l_shipdate").alias("seen_at"), F.col("l_orderkey").alias("run_id"))
    links = jobs.board_links(seen)
    return links.join(jobs.board_counts(links), "job_board_id").select("job_board_id", "job_post_id", "created_at", "last_seen_at", "last_seen_run", "num_job_posts")


@query(
    "q34_job_to_boards",
    "SELECT p_partkey, p_name, l_suppkey AS job_board_id, s_name AS board_name FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey",
)
def q34_job_to_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = table(spark, sf_dir, "part").select("p_partkey", "p_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = links.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select("p_partkey", "p_name", F.col("l_suppkey").alias("job_board_id"), F.col("s_name").alias("board_name"))


@query(
    "q38_api_lookup",
    f"""WITH j AS (SELECT DISTINCT url, s.provider AS provider, s.employer AS employer, s.job_id AS job_id, p_partkey FROM (SELECT url, p_partkey, {K.identified()} AS s FROM {K.parts(K.duck('ats_urls'), 'url')}) WHERE s.job_id IS NOT NULL AND NOT s.is_form),
    g AS (SELECT url, min(p_partkey) AS k, any_value(provider) AS provider FROM j GROUP BY url)
    SELECT url, CASE k % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'error' ELSE CASE WHEN provider = 'ashby' THEN CASE WHEN k % 2 = 0 THEN 'error' ELSE 'verified' END ELSE 'verified' END END AS result FROM g""",
)
def q38_api_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.relation(spark, sf_dir, "ats_urls").withColumn("it", ats.identify("url")).where("it.job_id IS NOT NULL AND NOT it.is_form")
    pages = rows.groupBy("url").agg(F.min("p_partkey").alias("k"), F.first("it").alias("it"))
    # One endpoint a job, so that each answer is this job's alone.
    pages = pages.withColumn("endpoint", F.concat(F.lit("api/"), "url"))
    posting = F.concat(F.lit('{"title":"t","jobUrl":"'), "url", F.lit('"}'))
    several = F.when(F.col("k") % 2 == 0, F.concat(posting, F.lit(","), posting)).otherwise(F.concat(posting, F.lit(',{"title":"o","jobUrl":"https://jobs.ashbyhq.com/other"}')))
    body = F.when(F.col("it.provider") == "ashby", F.concat(F.lit('{"jobs":['), several, F.lit("]}"))).otherwise(F.lit('{"id":1}'))
    responses = pages.select("endpoint", F.when(F.col("k") % 3 == 0, F.lit(404)).when(F.col("k") % 3 == 1, F.lit(500)).otherwise(F.lit(200)).alias("status"), body.alias("body"))
    wanted = pages.select("url", "endpoint", "it.provider", "it.employer", "it.job_id")
    return jobs.matched_payloads(wanted, responses).select("url", "result")


_LINKS = "SELECT concat('s', CAST(l_suppkey AS VARCHAR(20))) AS src, concat('p', CAST(l_partkey AS VARCHAR(20))) AS dst, l_orderkey * 10 + l_linenumber AS pos FROM {src} UNION ALL SELECT concat('p', CAST(l_partkey AS VARCHAR(20))), concat('s', CAST(l_suppkey AS VARCHAR(20))), l_orderkey * 10 + l_linenumber FROM {src}"
FRONTIER_DEPTH, FRONTIER_LINKS = 4, 3


@query(
    "q23_bfs_frontier",
    f"""WITH RECURSIVE l AS ({_LINKS.replace('{src}', 'lineitem')}), d AS (SELECT src, dst, min(pos) AS pos FROM l GROUP BY 1, 2), k AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pos, dst) AS n FROM d) WHERE n <= {FRONTIER_LINKS}),
    walk AS (SELECT 's' || s_suppkey AS node, 0 AS depth FROM supplier WHERE s_nationkey = 0 UNION SELECT dst, depth + 1 FROM walk JOIN k ON src = node WHERE depth < {FRONTIER_DEPTH})
    SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
)
def q23_bfs_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.sql(_LINKS, src=table(spark, sf_dir, "lineitem"))
    roots = table(spark, sf_dir, "supplier").where("s_nationkey = 0").selectExpr("concat('s', s_suppkey) AS node")
    return frontier.traverse(links, roots, FRONTIER_DEPTH, per_page=FRONTIER_LINKS)


@query(
    "q24_sitemap_walk",
    """WITH RECURSIVE m AS (SELECT 'm' || p_partkey AS url, 'm' || (p_partkey * 3 + k) AS child, k FROM part, (SELECT unnest([1, 2, 3]) AS k)),
    w AS (SELECT c_custkey AS root, ['m' || (c_custkey % 20 + 1), 'm' || (c_custkey % 7 + 1)] AS q FROM customer),
    d AS (SELECT root, list_distinct_ordered AS q, 1 AS i FROM (SELECT root, CASE WHEN q[1] = q[2] THEN [q[1]] ELSE q END AS list_distinct_ordered FROM w)
      UNION ALL SELECT root, list_concat(q, coalesce((SELECT list(child ORDER BY k) FROM m WHERE m.url = d.q[d.i] AND NOT list_contains(d.q, child)), [])), i + 1 FROM d WHERE i <= least(len(q), 10)),
    z AS (SELECT root, q, row_number() OVER (PARTITION BY root ORDER BY i DESC) AS n FROM d)
    SELECT root, u.url AS url, CAST(u.visit AS INTEGER) AS visit FROM (SELECT root, unnest(list_transform(range(1, least(len(q), 10) + 1), lambda v: {'url': q[v], 'visit': v})) AS u FROM z WHERE n = 1)""",
)
def q24_sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sitemaps = part.selectExpr("concat('m', p_partkey) AS url", "true AS is_index", "transform(array(1, 2, 3), k -> concat('m', p_partkey * 3 + k)) AS locs")
    customers = table(spark, sf_dir, "customer")
    seeds = customers.selectExpr("c_custkey AS root", "posexplode(array(concat('m', c_custkey % 20 + 1), concat('m', c_custkey % 7 + 1))) AS (pos, url)")
    return frontier.sitemap_walk(sitemaps, seeds)

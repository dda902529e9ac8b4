"""Pieces of DuckDB SQL that the oracles share: URL parts, normal form, suffix rule, derived relations."""

from __future__ import annotations

from siltstone.functions.ats import HOSTS, UUID
from siltstone.functions.urls import SKIPPED_SUFFIXES

SUFFIXES = ", ".join(f"'{s}'" for s in SKIPPED_SUFFIXES)


def parts(source: str, url: str, tag: str = "") -> str:
    """A subquery that adds parts of column `url` of `source`, their names ending in `tag`."""
    clean = f"regexp_replace(regexp_replace({url}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    return f"""(SELECT *, CASE WHEN pt{tag} = '' OR regexp_matches(pt{tag}, '^[0-9]{{1,5}}$') AND CAST(pt{tag} AS BIGINT) <= 65535 THEN true ELSE false END AS pok{tag},
    TRY_CAST(nullif(pt{tag}, '') AS INTEGER) AS port{tag} FROM
  (SELECT *, lower(replace(replace(regexp_extract(ad{tag}, '^(\\[[^\\]]*\\]|[^:]*)', 1), '[', ''), ']', '')) AS host{tag},
    regexp_extract(ad{tag}, '^(?:\\[[^\\]]*\\]|[^:]*):(.*)$', 1) AS pt{tag} FROM
  (SELECT *, lower(sp{tag}.s) AS scheme{tag}, sp{tag}.a AS auth{tag}, sp{tag}.p AS path{tag}, sp{tag}.q AS query{tag}, regexp_replace(sp{tag}.a, '^.*@', '') AS ad{tag} FROM
  (SELECT *, regexp_extract({clean}, '(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', ['s','a','p','q','f']) AS sp{tag} FROM {source}))))"""


def normal(tag: str = "") -> str:
    """The normal form, from columns of `parts`."""
    return f"""CASE WHEN scheme{tag} IN ('http','https') AND host{tag} <> '' AND pok{tag} THEN scheme{tag} || '://' || host{tag} ||
    CASE WHEN port{tag} IS NULL OR scheme{tag} = 'http' AND port{tag} = 80 OR scheme{tag} = 'https' AND port{tag} = 443 THEN '' ELSE ':' || port{tag} END ||
    CASE WHEN path{tag} = '' THEN '/' ELSE path{tag} END || CASE WHEN query{tag} = '' THEN '' ELSE '?' || query{tag} END END"""


def suffix(path: str) -> str:
    return f"lower(regexp_extract({path}, '[^/.][^/]*(\\.[^/.]*)$', 1))"


def canonical(tag: str = "") -> str:
    return f"CASE WHEN {suffix('path' + tag)} NOT IN ({SUFFIXES}) THEN {normal(tag)} END"


def identified(tag: str = "") -> str:
    """struct of provider, employer, job_id, is_form, from columns of `parts`."""
    who = "CASE host" + tag + " " + " ".join(f"WHEN '{h}' THEN '{p}'" for h, p in HOSTS.items()) + " END"
    seg = f"list_filter(string_split(path{tag}, '/'), lambda x: x <> '')"
    usable = f"(scheme{tag} IN ('http','https') AND NOT regexp_matches(regexp_extract(auth{tag}, '^(.*)@', 1), '[^:]') AND pok{tag} AND coalesce(port{tag} IN (80, 443), true))"
    told = lambda job, form: f"{{'provider': {who}, 'employer': ({seg})[1], 'job_id': {job}, 'is_form': {form}}}"
    return f"""CASE WHEN NOT {usable} OR {who} IS NULL OR len({seg}) = 0 THEN NULL
    WHEN len({seg}) = 1 THEN {told("CAST(NULL AS VARCHAR)", "false")}
    WHEN {who} = 'greenhouse' AND len({seg}) = 3 AND ({seg})[2] = 'jobs' AND regexp_matches(({seg})[3], '^[0-9]+$') THEN {told(f"({seg})[3]", "false")}
    WHEN {who} <> 'greenhouse' AND regexp_matches(({seg})[2], '{UUID}') AND len({seg}) = 2 THEN {told(f"({seg})[2]", "false")}
    WHEN {who} <> 'greenhouse' AND regexp_matches(({seg})[2], '{UUID}') AND len({seg}) = 3 AND ({seg})[3] = CASE WHEN {who} = 'ashby' THEN 'application' ELSE 'apply' END
      THEN {told(f"({seg})[2]", "true")} END"""


#: Derived relations, in SQL that Spark and DuckDB both read; {sha}(x) is sha256 in hex.
STAMP = "'2026-01-' || lpad(CAST(1 + CAST(floor({m} / 1440) AS INT) % 28 AS VARCHAR(2)), 2, '0') || 'T' || lpad(CAST(CAST(floor(({m} % 1440) / 60) AS INT) AS VARCHAR(2)), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR(2)), 2, '0') || ':00+00:00'"


def stamp(minutes: str) -> str:
    return STAMP.format(m=f"({minutes})")


CRAWL_PAGES = f"""
SELECT page_id, regexp_extract(url, '//([^/:?#]+)', 1) AS site_id, concat('run_', CAST(page_id % 40 AS VARCHAR(20))) AS crawl_run_id, url, {{sha}} AS canonical_url_hash,
  page_id % 5 AS depth, CASE page_id % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'CRAWLING_AND_PARSING' ELSE 'COMPLETED' END AS status,
  page_id % 3 AS attempt_count, page_id % 4 AS children_attempt_count, page_id % 2 = 0 AS dispatch_pending,
  CASE WHEN page_id % 7 = 2 THEN {stamp('page_id')} END AS lease_expires_at, CASE WHEN page_id % 11 = 3 THEN {stamp('page_id + 90')} END AS retry_after,
  CASE WHEN page_id % 6 <> 5 THEN {stamp('page_id + 30')} END AS dispatch_after, CASE WHEN page_id % 5 = 2 THEN concat('parsed/', CAST(page_id AS VARCHAR(20))) END AS parsed_key,
  concat('token_', CAST(page_id % 3 AS VARCHAR(20))) AS worker_token, {stamp('page_id')} AS created_at,
  CASE WHEN page_id % 9 <> 0 THEN concat('https://parent.example/', CAST(CAST(floor(page_id / 9) AS INT) AS VARCHAR(20))) END AS parent_url
FROM pages"""

CRAWL_RUNS = f"""
SELECT concat('run_', CAST(p_partkey % 44 AS VARCHAR(20))) AS crawl_run_id, concat('site_', CAST(min(p_partkey) % 5 AS VARCHAR(20))) AS site_id,
  CASE min(p_partkey) % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'CRAWLING_AND_PARSING' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'FAILED' ELSE 'PENDING' END AS status
FROM part GROUP BY concat('run_', CAST(p_partkey % 44 AS VARCHAR(20)))"""

PAGE_VERSIONS = """
SELECT event_id, concat('site_', CAST(user_id % 10 AS VARCHAR(20))) AS site_id, CAST(user_id AS VARCHAR(20)) AS url, ts AS crawled_at, event_id % 4 AS run_no, event_type AS body FROM events"""

ATS_URLS = """
SELECT p_partkey, concat(
  CASE p_partkey % 9 WHEN 0 THEN 'https://jobs.ashbyhq.com' WHEN 1 THEN 'https://boards.greenhouse.io' WHEN 2 THEN 'http://jobs.lever.co:80' WHEN 3 THEN 'https://jobs.eu.lever.co'
    WHEN 4 THEN 'https://job-boards.eu.greenhouse.io' WHEN 5 THEN 'https://u:p@jobs.lever.co' WHEN 6 THEN 'https://jobs.ashbyhq.com:8443' WHEN 7 THEN 'https://JOBS.lever.co' ELSE 'https://jobs.example.com' END,
  '/emp', CAST(p_partkey % 13 AS VARCHAR(20)),
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('/jobs/', CAST(p_partkey AS VARCHAR(20))) WHEN 5 THEN '/about'
    ELSE concat('/', substr({sha}, 1, 8), '-', substr({sha}, 9, 4), '-', substr({sha}, 13, 4), '-', substr({sha}, 17, 4), '-', substr({sha}, 21, 12)) END,
  CASE WHEN p_partkey % 6 = 3 THEN '/application' WHEN p_partkey % 6 = 4 THEN '/apply' ELSE '' END) AS url, p_name, p_type
FROM part"""

_SHA = {"crawl_pages": "url", "ats_urls": "CAST(p_partkey % 50 AS VARCHAR(20))"}


def derived(name: str, dialect: str) -> str:
    """A derived relation as SQL of `spark` or `duckdb`."""
    text = {"crawl_pages": CRAWL_PAGES, "crawl_runs": CRAWL_RUNS, "page_versions": PAGE_VERSIONS, "ats_urls": ATS_URLS}[name]
    column = _SHA.get(name)
    if column:
        text = text.replace("{sha}", f"sha2({column}, 256)" if dialect == "spark" else f"sha256({column})")
    return text


def relation(spark, sf_dir: str, name: str):
    """A derived relation as a DataFrame."""
    from siltstone.tables import table

    source = {"crawl_pages": "pages", "crawl_runs": "part", "page_versions": "events", "ats_urls": "part"}[name]
    return spark.sql(derived(name, "spark").replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


def duck(name: str) -> str:
    """A derived relation as a parenthesised DuckDB subquery."""
    return f"({derived(name, 'duckdb')})"

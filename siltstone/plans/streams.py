"""Queries that run as streams, and those that need parsers in Python (rows only where SQL cannot tell)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import documents
from siltstone.operators import ledger
from siltstone.plans import sqlkit as K
from siltstone.plans.catalogue import query
from siltstone.plans.ledger import MAX_ATTEMPTS, NOW
from siltstone.sources import fetch
from siltstone.streaming import ledger_stream as streams
from siltstone.tables import table


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a queue that delivers some of them twice."""
    events = table(spark, sf_dir, "events").selectExpr("event_id AS message_id", "concat('run_', user_id % 7) AS run_id", "concat('u', user_id, '_', event_id % 3) AS url", "event_id AS sent_at", "30 * (event_id % 4) AS delay", "ts")
    return events.unionByName(events.where("message_id % 11 = 0"))


@query("s01_stream_ledger", "SELECT 'run_' || (user_id % 7) AS run_id, 'u' || user_id || '_' || (event_id % 3) AS url, count(DISTINCT event_id) >= 1 AS claimed FROM events GROUP BY 1, 2")
def s01_stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir).select("run_id", "url", "sent_at")
    state = streams.claims(streams.message_stream(spark, messages), messages.limit(0), ["run_id", "url"], ["sent_at"])
    return state.select("run_id", "url", F.col("sent_at").isNotNull().alias("claimed"))


@query("s02_stream_dedup", "SELECT event_id AS message_id, ts FROM events")
def s02_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir).select("message_id", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.deduplicated(streams.message_stream(spark, messages), "message_id", "ts", "3650 days")
    return out.select("message_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("s03_batch_failures", "SELECT event_id AS message_id, event_id + 30 * (event_id % 4) AS visible_at FROM events WHERE event_id % 5 = 0")
def s03_batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir).select("message_id", "sent_at", "delay").distinct()
    return streams.partial_failures(streams.message_stream(spark, messages), F.col("message_id") % 5 == 0)


@query(
    "s04_sweep",
    f"""SELECT action, count(*) AS pages FROM (SELECT CASE WHEN status IN ('COMPLETED','FAILED') THEN 'skip' WHEN coalesce(lease_expires_at, '') > '{NOW}' THEN 'skip' WHEN coalesce(retry_after, '') > '{NOW}' THEN 'skip'
    WHEN CASE WHEN parsed_key IS NOT NULL THEN children_attempt_count >= 2 ELSE attempt_count >= {MAX_ATTEMPTS} END THEN 'fail' WHEN dispatch_pending OR coalesce(dispatch_after, '') <= '{NOW}' THEN 'dispatch' ELSE 'skip' END AS action FROM {K.duck('crawl_pages')}) GROUP BY 1""",
)
def s04_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.relation(spark, sf_dir, "crawl_pages").select(ledger.recovery_action(NOW, MAX_ATTEMPTS).alias("action")).groupBy("action").agg(F.count("*").alias("pages"))


@query(
    "s05_fetch_rules",
    """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'not_found' WHEN page_id % 7 = 1 THEN 'http_error' WHEN page_id % 5 = 0 THEN 'unsupported_type' WHEN strlen(html) > 3000 THEN 'too_large' END AS fault FROM pages""",
)
def s05_fetch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status", "CASE WHEN page_id % 5 = 0 THEN 'image/png' ELSE 'Text/HTML; charset=utf-8' END AS content_type", "html AS content",
    )
    return fetch.replayed(rows, cap=3000).select("page_id", "fault")


#: Texts that a worker holds as Python objects at once.
SLICE_BYTES = 2_000_000
_TEXT, _TEXTS = ("string", pa.string()), ("array<string>", pa.list_(pa.string()))
_HEADINGS = ("array<struct<level: string, text: string>>", pa.list_(pa.struct([("level", pa.string()), ("text", pa.string())])))
#: What the parsers read, as Spark and Arrow name its type.
PARSED = {"title": _TEXT, "language": _TEXT, "description": _TEXT, "headings": _HEADINGS, "links": _TEXTS, "main_content": _TEXT}


def slices(batches: Iterator[pa.RecordBatch], texts: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `most` bytes of the column `texts`, or of one row.

    Spark's batches have up to 10,000 rows; what is made of them in Python is several times their bytes.
    """
    for batch in batches:
        sizes, start, held = pc.binary_length(batch[texts]).to_pylist(), 0, 0
        for at, size in enumerate(sizes):
            if held and held + (size or 0) > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size or 0
        yield batch.slice(start)
        del batch  # not held while the next one is read


def parsed(rows: DataFrame, read: Callable[[str | None], dict], *fields: str) -> DataFrame:
    """The first column of `rows`, a long, and `fields` of what `read` tells of the second, a text."""
    key, texts = rows.columns

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, texts):
            found = [{c: told[c] for c in fields} for told in map(read, part[texts].to_pylist())]
            yield pa.record_batch([part[key], *[pa.array([f[c] for f in found], PARSED[c][1]) for c in fields]], [key, *fields])

    return rows.mapInArrow(parse, ", ".join([f"{key} long", *[f"{c} {PARSED[c][0]}" for c in fields]]))


def _page(markup: str | None) -> dict:
    found = documents.parse_html(markup)
    return found | {"links": [a["href"] for a in found["links"]]}


@query("u01_html_tree", """SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title,
    regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS language, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS n_headings, len(regexp_extract_all(html, '<a href="')) AS n_links FROM pages""")
def u01_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsed(table(spark, sf_dir, "pages").select("page_id", "html"), _page, "title", "language", "headings", "links")
    return out.select("page_id", "title", "language", F.size("headings").cast("long").alias("n_headings"), F.size("links").cast("long").alias("n_links"))


@query("u02_markdown")
def u02_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Note "), F.col("doc_id").cast("string"), F.lit("\n\n[a](/x"), F.col("doc_id").cast("string"), F.lit(") and <https://e.example/>\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return parsed(docs, documents.parse_markdown, "title", "description", "headings", "links")


@query("u03_main_content")
def u03_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "pages").select("page_id", "html"), _page, "main_content")


@query("u04_robots", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE c_custkey % 3 <> 0 END AS allowed FROM customer")
def u04_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("boolean")
    def allowed(status: pd.Series, body: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([documents.robots_allow(s, b, "siltstone", u) for s, b, u in zip(status, body, url)])

    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 403 WHEN 1 THEN 500 ELSE 200 END AS status", "concat('https://h.example/', CASE WHEN c_custkey % 3 = 0 THEN 'private/' ELSE 'open/' END, c_custkey) AS url")
    return rows.select("c_custkey", allowed("status", F.lit("User-agent: *\nAllow: /open\nDisallow: /private\n"), "url").alias("allowed"))


@query("u05_json_walk", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS n_urls, p_partkey % 2 = 0 AS posting FROM part")
def u05_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("n_urls int, posting boolean")
    def walked(scripts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n_urls": [len(documents.embedded_job_urls([s])) for s in scripts], "posting": [documents.single_job_posting([s]) is not None for s in scripts]})

    script = """concat('{"a":[{"b":"https://boards.greenhouse.io/e', p_partkey % 5, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('/jobs/', p_partkey) END, '"}],"c":', CASE WHEN p_partkey % 2 = 0 THEN '{"@type":["JobPosting"]}' ELSE '[]' END, '}')"""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{script} AS script").withColumn("w", walked("script"))
    return rows.select("p_partkey", "w.n_urls", "w.posting")

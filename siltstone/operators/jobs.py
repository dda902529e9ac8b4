"""Job posts, boards and links: payload normal form, first-wins inserts, exactly-once counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import ats

INLINE_BYTES, LOCATION_BYTES, RECORD_BYTES = 200_000, 10_000, 390_000


def _text(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path)


def _filled(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) != ""


def normalise_payload(provider: Column, job_id: Column, payload: Column) -> Column:
    """struct<title, description, location, fault> of one job's API payload (JSON text).

    `fault` names the first broken rule, or is null: not_an_object, other_job, no_title, no_description.
    """
    empty_is_missing = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    title = F.when(provider == "lever", _text(payload, "$.text")).otherwise(_text(payload, "$.title"))
    description = (
        F.when(provider == "ashby", empty_is_missing(_text(payload, "$.descriptionHtml"), _text(payload, "$.descriptionPlain")))
        .when(provider == "greenhouse", _text(payload, "$.content"))
        .otherwise(empty_is_missing(_text(payload, "$.description"), _text(payload, "$.descriptionPlain")))
    )
    place = F.when(provider == "lever", _text(payload, "$.categories.location")).otherwise(_text(payload, "$.location"))
    # A location object counts by its name.
    place = F.when(place.startswith("{"), F.get_json_object(place, "$.name")).otherwise(place)
    place = F.when(F.octet_length(place) <= LOCATION_BYTES, place)
    told_id = F.when(provider != "ashby", _text(payload, "$.id"))
    fault = (
        F.when(payload.isNull() | ~F.coalesce(F.trim(payload).startswith("{"), F.lit(False)), F.lit("not_an_object"))
        .when((provider != "ashby") & ~told_id.eqNullSafe(job_id), F.lit("other_job"))
        .when(~_filled(title), F.lit("no_title"))
        .when(~_filled(description), F.lit("no_description"))
    )
    return F.struct(title.alias("title"), description.alias("description"), place.alias("location"), fault.alias("fault"))


def placed_description(description: Column, key: Column) -> Column:
    """struct<description, description_key>: inline up to INLINE_BYTES, else by reference."""
    small = F.octet_length(description) <= INLINE_BYTES
    return F.struct(F.when(small, description).alias("description"), F.when(~small, key).alias("description_key"))


def first_jobs(seen: DataFrame) -> DataFrame:
    """One row a job, from its first sighting (created_at, then url): records never change afterwards."""
    keyed = seen.withColumn("job_post_id", ats.job_post_id(F.col("ats_provider"), F.col("employer_slug"), F.col("employer_job_id")))
    rest = [c for c in seen.columns]
    first = keyed.groupBy("job_post_id").agg(F.min_by(F.struct(*rest), F.struct("created_at", "url")).alias("row"))
    return first.select("job_post_id", "row.*")


def board_links(seen: DataFrame) -> DataFrame:
    """One row a (board, job): first and last sighting, and the run of the last one."""
    return seen.groupBy("job_board_id", "job_post_id").agg(
        F.min("seen_at").alias("created_at"), F.max("seen_at").alias("last_seen_at"), F.max_by("run_id", F.struct("seen_at", "run_id")).alias("last_seen_run"),
    )


def board_counts(links: DataFrame) -> DataFrame:
    """Distinct jobs of each board, from the set of links and not from increments."""
    return links.groupBy("job_board_id").agg(F.count_distinct("job_post_id").alias("num_job_posts"))


def matched_payloads(jobs: DataFrame, responses: DataFrame) -> DataFrame:
    """Jobs (url, endpoint, provider, employer, job_id) with their payload among API responses
    (endpoint, status, body): list answers are searched for the one posting of the same job.

    `result`: absent (404 or no match), error (other status, several matches), or verified.
    """
    joined = jobs.join(responses, "endpoint", "left")
    listed = joined.where("provider = 'ashby' AND status = 200").select("url", F.explode(F.from_json(F.get_json_object("body", "$.jobs"), "array<string>")).alias("job"), "provider", "employer", "job_id")
    it = ats.identify(F.get_json_object("job", "$.jobUrl"))
    listed = listed.withColumn("it", it).where("it.provider = provider AND it.employer = employer AND it.job_id = job_id AND NOT it.is_form")
    found = listed.groupBy("url").agg(F.count("*").alias("matches"), F.min("job").alias("match"))
    out = joined.join(found, "url", "left")
    payload = F.when(F.col("provider") == "ashby", F.col("match")).otherwise(F.col("body"))
    result = (
        F.when(F.coalesce(F.col("status"), F.lit(404)) == 404, F.lit("absent"))
        .when(F.col("status") != 200, F.lit("error"))
        .when((F.col("provider") == "ashby") & (F.coalesce("matches", F.lit(0)) == 0), F.lit("absent"))
        .when((F.col("provider") == "ashby") & (F.col("matches") > 1), F.lit("error"))
        .otherwise(F.lit("verified"))
    )
    return out.select("url", "endpoint", "provider", "employer", "job_id", result.alias("result"), F.when(result == "verified", payload).alias("payload"))

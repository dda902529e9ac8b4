"""Recognise job boards, job pages and application forms by URL; job identity and API payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.functions.values import ascii_json

#: Hosts of job boards and their providers (fixed values).
HOSTS = {
    "jobs.ashbyhq.com": "ashby", "boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "boards.eu.greenhouse.io": "greenhouse",
    "job-boards.eu.greenhouse.io": "greenhouse", "jobs.lever.co": "lever", "jobs.eu.lever.co": "lever",
}
#: The form of an employer's job id (fixed value).
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: Last path segment of an application form (fixed values).
FORMS = {"ashby": "application", "lever": "apply"}


def _provider(p: Column) -> Column:
    by_host = F.create_map(*[F.lit(x) for pair in HOSTS.items() for x in pair])
    usual = F.coalesce(urls._port(p).isin(80, 443), F.lit(True))
    return F.when(urls._scheme(p).isin("http", "https") & ~urls._has_credentials(p) & urls._port_valid(p) & usual, by_host[p[5]])


def identify(url: Column | str) -> Column:
    """struct<provider, employer, job_id, is_form> of a board, job or form URL, or null."""

    def identified(s: Column) -> Column:
        who, segments = s["who"], s["segments"]
        n = F.size(segments)
        first, second, third = (F.get(segments, F.lit(k)) for k in range(3))
        told = lambda job, form: F.struct(who.alias("provider"), first.alias("employer"), job.alias("job_id"), F.lit(form).alias("is_form"))
        form = F.when(who == "ashby", F.lit(FORMS["ashby"])).otherwise(F.lit(FORMS["lever"]))
        return (
            F.when(who.isNull() | (n == 0), F.lit(None))
            .when(n == 1, told(F.lit(None).cast("string"), False))
            .when((who == "greenhouse") & (n == 3) & (second == "jobs") & third.rlike("^[0-9]+$"), told(third, False))
            .when((who != "greenhouse") & second.rlike(UUID) & (n == 2), told(second, False))
            .when((who != "greenhouse") & second.rlike(UUID) & (n == 3) & (third == form), told(second, True))
        )

    shape = lambda p: F.struct(_provider(p).alias("who"), F.filter(F.split(p[2], "/"), lambda x: x != "").alias("segments"))
    return urls.let(urls.let(urls.parts(url), shape), identified)


def percent_encode(text: Column) -> Column:
    """Percent-encode with nothing but unreserved characters safe."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def endpoint(url: Column | str) -> Column:
    """The API address of a job page; null for other pages and for hosts without a known route."""

    def address(s: Column) -> Column:
        it, h = s["it"], s["h"]
        company, job = percent_encode(it["employer"]), percent_encode(it["job_id"])
        lever = F.when(h == "jobs.eu.lever.co", F.lit("https://api.eu.lever.co/v0/postings/")).otherwise(F.lit("https://api.lever.co/v0/postings/"))
        known = (
            F.when(it["provider"] == "ashby", F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), company))
            .when((it["provider"] == "greenhouse") & ~h.contains(".eu.greenhouse.io"), F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), company, F.lit("/jobs/"), job))
            .when(it["provider"] == "lever", F.concat(lever, company, F.lit("/"), job, F.lit("?mode=json")))
        )
        return F.when(it["job_id"].isNotNull() & ~it["is_form"], known)

    return urls.let(F.struct(identify(url).alias("it"), urls.host(url).alias("h")), address)


def job_post_id(who: Column, employer: Column, job_id: Column) -> Column:
    """sha256 of the compact JSON list of provider, employer and job id, all but ASCII escaped; null if one is."""
    return F.sha2(F.concat(F.lit("["), ascii_json(who), F.lit(","), ascii_json(employer), F.lit(","), ascii_json(job_id), F.lit("]")), 256)

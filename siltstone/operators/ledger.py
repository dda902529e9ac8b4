"""Page and run state machines as pure column transitions over snapshots.

A snapshot is a DataFrame of pages (one row a page). Each transition takes a snapshot, applies where
its guard holds and leaves other rows as they are; missing values follow the store's rules: a missing
counter is 0, a missing time lies in the past. Times are UTC ISO strings compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUEUED, WORKING, COMPLETED, FAILED, PENDING = "QUEUED", "CRAWLING_AND_PARSING", "COMPLETED", "FAILED", "PENDING"
TERMINAL = (COMPLETED, FAILED)
MAX_CHILDREN_ATTEMPTS = 2
ERROR_CHARS = 1000
#: Errors that end a page at once (fixed values).
TERMINAL_ERRORS = ("PageNotFoundError", "ResponseTooLargeError", "RobotsDeniedError", "UnsafeUrlError", "UnsupportedContentTypeError")


def count_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def exhausted(max_attempts: int) -> Column:
    """No attempt is left: of child registration once there is a parsed checkpoint, else of processing."""
    return F.when(F.col("parsed_key").isNotNull(), count_of("children_attempt_count") >= MAX_CHILDREN_ATTEMPTS).otherwise(count_of("attempt_count") >= max_attempts)


def owned(token: Column, now: str) -> Column:
    """A working page with this token and a lease that has not run out."""
    return F.coalesce((F.col("status") == WORKING) & (F.col("worker_token") == token) & (F.col("lease_expires_at") > now), F.lit(False))


def claimable(now: str, max_attempts: int) -> Column:
    """A page that a worker may take: queued, or working with an expired lease; no delay; attempts left."""
    free = (F.col("status") == QUEUED) | ((F.col("status") == WORKING) & (F.coalesce("lease_expires_at", F.lit("")) <= now))
    return free & (F.coalesce("retry_after", F.lit("")) <= now) & ~exhausted(max_attempts)


def claim(pages: DataFrame, requests: DataFrame, runs: DataFrame, now: str, expires: str, max_attempts: int) -> DataFrame:
    """Requests (key columns, token, at_) against pages: the first request of each claimable page of an
    active run wins. Returns the key, the winner's token and the page's new counters."""
    keys = ["crawl_run_id", "canonical_url_hash"]
    first = requests.groupBy(*keys).agg(F.min(F.struct("at_", "token")).alias("w"))
    active = runs.where(F.col("status").isin(PENDING, WORKING)).select("crawl_run_id")
    won = pages.where(claimable(now, max_attempts)).join(first, keys).join(active, "crawl_run_id", "left_semi")
    parsed = F.col("parsed_key").isNotNull().cast("int")
    return won.select(*keys, F.col("w.token").alias("worker_token"), (count_of("attempt_count") + 1 - parsed).alias("attempt_count"), (count_of("children_attempt_count") + parsed).alias("children_attempt_count"), F.lit(expires).alias("lease_expires_at"))


def finish(error: Column) -> dict[str, Column]:
    """New values of an owned page that ends: failed if there is an error, its lease gone."""
    none = F.lit(None).cast("string")
    return {
        "status": F.when(error.isNull(), F.lit(COMPLETED)).otherwise(F.lit(FAILED)), "last_error": F.substring(error, 1, ERROR_CHARS), "worker_token": none,
        "lease_expires_at": none, "retry_after": none, "dispatch_pending": F.lit(None).cast("boolean"),
    }


def retry(error: Column, now: str, retry_after: str, refund: Column) -> dict[str, Column]:
    """New values of an owned page that is tried again: same status, lease over, token gone."""
    children = count_of("children_attempt_count")
    return {
        "last_error": F.substring(error, 1, ERROR_CHARS), "lease_expires_at": F.lit(now), "retry_after": F.lit(retry_after), "worker_token": F.lit(None).cast("string"),
        "children_attempt_count": F.when(refund & (children > 0), children - 1).otherwise(children),
    }


def recovery_action(now: str, max_attempts: int) -> Column:
    """What a sweep does with a page: skip, fail or dispatch."""
    return (
        F.when(F.col("status").isin(*TERMINAL), F.lit("skip"))
        .when(F.coalesce("lease_expires_at", F.lit("")) > now, F.lit("skip"))
        .when(F.coalesce("retry_after", F.lit("")) > now, F.lit("skip"))
        .when(exhausted(max_attempts), F.lit("fail"))
        .when(F.coalesce("dispatch_pending", F.lit(False)) | (F.coalesce("dispatch_after", F.lit("")) <= now), F.lit("dispatch"))
        .otherwise(F.lit("skip"))
    )


def outcome(error_class: Column, max_attempts: int) -> Column:
    """finish without an error; fail on a terminal error or without attempts; else retry."""
    return F.when(error_class.isNull(), F.lit("finish")).when(error_class.isin(*TERMINAL_ERRORS) | exhausted(max_attempts), F.lit("fail")).otherwise(F.lit("retry"))


def progress(pages: DataFrame) -> DataFrame:
    """Counts of each run: total, completed, failed and the rest."""
    done, failed = F.count_if(F.col("status") == COMPLETED), F.count_if(F.col("status") == FAILED)
    return pages.groupBy("crawl_run_id").agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), (F.count("*") - done - failed).alias("pending"))


def verdict(pages: DataFrame) -> DataFrame:
    """Runs whose pages have all ended: completed if any page is, incomplete if any failed."""
    told = progress(pages).where("pending = 0 AND total > 0")
    return told.select("crawl_run_id", F.when(F.col("completed") > 0, F.lit(COMPLETED)).otherwise(F.lit(FAILED)).alias("status"), F.col("completed").alias("completed_page_count"), F.col("failed").alias("failed_page_count"), (F.col("failed") > 0).alias("incomplete"))


def disposition(messages: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """What becomes of each message: drop_orphan, mismatch, drop_run_ended, completion_check or work."""
    keys = ["crawl_run_id", "canonical_url_hash"]
    p = pages.select(*keys, F.col("url").alias("page_url"), F.col("status").alias("page_status"))
    r = runs.select("crawl_run_id", F.col("status").alias("run_status"))
    joined = messages.join(p, keys, "left").join(r, "crawl_run_id", "left")
    told = (
        F.when(F.col("page_status").isNull(), F.lit("drop_orphan"))
        .when(F.col("page_url") != F.col("url"), F.lit("mismatch"))
        .when(F.col("run_status").isNull() | F.col("run_status").isin(*TERMINAL), F.lit("drop_run_ended"))
        .when(F.col("page_status").isin(*TERMINAL), F.lit("completion_check"))
        .otherwise(F.lit("work"))
    )
    return joined.withColumn("disposition", told)


def register_children(candidates: DataFrame, pages: DataFrame, capacity: int | None, batch: int = 50) -> DataFrame:
    """New child pages of each run: distinct hashes not yet known, up to what the run's cap leaves, in
    batches. `candidates` has crawl_run_id, canonical_url_hash, pos and any other columns.

    The rank within a run needs its candidates in order; a run is the unit that the cap bounds.
    """
    keys = ["crawl_run_id", "canonical_url_hash"]
    known = pages.select(*keys).distinct()
    first = candidates.groupBy(*keys).agg(F.min("pos").alias("pos")).join(known, keys, "left_anti")
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("crawl_run_id").orderBy("pos", "canonical_url_hash")))
    if capacity is not None:
        room = known.groupBy("crawl_run_id").agg(F.greatest(F.lit(0), F.lit(capacity) - F.count("*")).alias("room"))
        ranked = ranked.join(room, "crawl_run_id", "left").where(F.col("n") <= F.coalesce("room", F.lit(capacity)))
    return ranked.select(*keys, "pos", F.col("n").alias("child_no"), F.expr(f"(n - 1) div {batch}").cast("int").alias("batch_no"))

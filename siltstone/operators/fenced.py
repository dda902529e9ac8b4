"""Guarded writes over snapshots: set, remove, add or delete under a condition, refused ones reported.

`requests` has a row for each write: the key and what the write carries. A request is applied where
its row exists (or not, for inserts) and its guard holds; else it is a conflict, which callers may
raise, count or ignore. Requests of one key are taken to be one (reduce them first, as `ledger.claim`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import ledger

ACTIVE_RUN = (ledger.PENDING, ledger.WORKING)
#: How a refused write is named (fixed value of this engine).
CONFLICT = "ConditionNotMet"


Write = tuple[Column, dict[str, Column]]


def outcome(guard: Column, changes: dict[str, Column]) -> dict[str, Column]:
    """`error` (null or CONFLICT) and the new values, where a row holds both a page's state and what is asked of it.

    `changes` tells new values: a null removes, `count_of(x) + n` adds; a refused write leaves what was there.
    """
    ok = F.coalesce(guard, F.lit(False))
    return {"error": F.when(~ok, F.lit(CONFLICT)), **{c: F.when(ok, v).otherwise(F.col(c)) for c, v in changes.items()}}


def guarded(snapshot: DataFrame, requests: DataFrame, keys: list[str], guard: Column, changes: dict[str, Column]) -> DataFrame:
    """One row per request: key, `error` and the row's values after it (see `outcome`).

    Keys name one row of the snapshot each. Columns of requests must not clash with the snapshot's but for the keys.
    """
    return requests.join(snapshot, keys, "left").select(*keys, *[v.alias(c) for c, v in outcome(guard, changes).items()])


def deleted(snapshot: DataFrame, requests: DataFrame, keys: list[str], guard: Column) -> DataFrame:
    """The snapshot without the rows that a request names and for which the guard holds."""
    gone = snapshot.where(F.coalesce(guard, F.lit(False))).join(requests, keys, "left_semi").select(*keys)
    return snapshot.join(gone, keys, "left_anti")


def applied(snapshot: DataFrame, writes: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot with the values of `writes` (result of `guarded`) that were not refused."""
    names = [c for c in writes.columns if c not in (*keys, "error")]
    good = writes.where("error IS NULL").select(*keys, *[F.col(c).alias(f"new_{c}") for c in names], F.lit(True).alias("written_"))
    out = snapshot.join(good, keys, "left")
    return out.select(*[F.when(F.col("written_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in snapshot.columns])


def saving(now: str, fields: list[str]) -> Write:
    """Checkpoint attributes (`new_<field>` of requests) while the requesting worker (`token`) owns the page."""
    return ledger.owned(F.col("token"), now), {f: F.col(f"new_{f}") for f in fields}


def starting_children(now: str) -> Write:
    """Count the first child attempt after parsing: owned, parsed, and an attempt left."""
    left = F.col("parsed_key").isNotNull() & (ledger.count_of("children_attempt_count") < ledger.MAX_CHILDREN_ATTEMPTS)
    return ledger.owned(F.col("token"), now) & left, {"children_attempt_count": ledger.count_of("children_attempt_count") + 1}


def marking_sent(dispatch_after: str) -> Write:
    """After a send: no dispatch is pending and the next check is later, unless the page moved on
    (`seen_attempts` of the request is no longer its count)."""
    same = (F.col("attempt_count") == F.col("seen_attempts")) & F.col("status").isin(ledger.QUEUED, ledger.WORKING)
    return same, {"dispatch_pending": F.lit(False), "dispatch_after": F.lit(dispatch_after)}


def save_result(pages: DataFrame, requests: DataFrame, keys: list[str], now: str, fields: list[str]) -> DataFrame:
    """`saving` for requests that stand apart from the pages."""
    return guarded(pages, requests, keys, *saving(now, fields))


def start_children(pages: DataFrame, requests: DataFrame, keys: list[str], now: str) -> DataFrame:
    """`starting_children` for requests that stand apart from the pages."""
    return guarded(pages, requests, keys, *starting_children(now))


def mark_sent(pages: DataFrame, requests: DataFrame, keys: list[str], dispatch_after: str) -> DataFrame:
    """`marking_sent` for requests that stand apart from the pages."""
    return guarded(pages, requests, keys, *marking_sent(dispatch_after))


def acquire_lock(runs: DataFrame, requests: DataFrame, keys: list[str], now: str, expires: str) -> DataFrame:
    """An expiring lock of an active run: free, or held past its end."""
    free = F.col("lock_expires_at").isNull() | (F.col("lock_expires_at") <= now)
    return guarded(runs, requests, keys, F.col("status").isin(*ACTIVE_RUN) & free, {"lock_token": F.col("token"), "lock_expires_at": F.lit(expires)})


def release_lock(runs: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Remove a lock that the requesting token holds."""
    none = F.lit(None).cast("string")
    return guarded(runs, requests, keys, F.col("lock_token") == F.col("token"), {"lock_token": none, "lock_expires_at": none})


def start_runs(sites: DataFrame, runs: DataFrame, pages: DataFrame, requests: DataFrame, now: str) -> dict[str, DataFrame]:
    """Rows that new runs add: of `requests` (site_id, crawl_run_id, root_url) those whose run is not there.

    `sites` are upserted, the run and its root page (depth 0, queued, pending dispatch) are inserted; a run
    that exists, or whose root page does, adds nothing at all.
    """
    page = F.sha2("root_url", 256).alias("canonical_url_hash")
    new = requests.join(runs.select("site_id", "crawl_run_id"), ["site_id", "crawl_run_id"], "left_anti").select("*", page)
    new = new.join(pages.select("crawl_run_id", "canonical_url_hash"), ["crawl_run_id", "canonical_url_hash"], "left_anti")
    stamped = [F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")]
    return {
        "sites": new.groupBy("site_id").agg(F.min("root_url").alias("root_url")).join(sites.select("site_id", F.col("created_at").alias("before")), "site_id", "left").select("site_id", "root_url", F.coalesce("before", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at")),
        "runs": new.select("site_id", "crawl_run_id", "root_url", F.lit(ledger.PENDING).alias("status"), *stamped),
        "pages": new.select("crawl_run_id", "canonical_url_hash", "site_id", F.col("root_url").alias("url"), F.lit(0).alias("depth"), F.lit(ledger.QUEUED).alias("status"), F.lit(0).alias("attempt_count"), F.lit(True).alias("dispatch_pending"), *stamped),
    }


def linked(boards: DataFrame, links: DataFrame, requests: DataFrame) -> DataFrame:
    """What linking a job to a board does: `created` (and the board counts one more), `seen` if the link is
    there, or the error `MissingBoard`. One row per distinct (job_board_id, job_post_id)."""
    asked = requests.select("job_board_id", "job_post_id").distinct()
    there = links.select("job_board_id", "job_post_id", F.lit(True).alias("there")).distinct()
    board = boards.select("job_board_id", F.lit(True).alias("board"))
    out = asked.join(there, ["job_board_id", "job_post_id"], "left").join(board, "job_board_id", "left")
    return out.select("job_board_id", "job_post_id", F.when(F.col("there"), F.lit("seen")).when(F.col("board"), F.lit("created")).otherwise(F.lit("MissingBoard")).alias("outcome"))


def next_stage(raw: Column, verified: Column, parsed: Column, children: Column) -> Column:
    """Where a resumed page goes on: the first stage whose checkpoint it lacks."""
    return F.when(raw.isNull(), F.lit("fetch")).when(verified.isNull(), F.lit("verify")).when(parsed.isNull(), F.lit("parse")).when(~F.coalesce(children, F.lit(False)), F.lit("children")).otherwise(F.lit("finish"))

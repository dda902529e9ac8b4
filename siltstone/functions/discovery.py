"""Which addresses a page leads to: scope, final hops, and ordered unions of lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import ats, urls


def should_discover(candidate: Column | str, root: Column | str, depth: Column, max_depth: int) -> Column:
    """A job posting is followed at any depth and an application form at none; a board is followed below
    the depth limit wherever it is, another page only inside the root's scope."""
    site = ats.identify(candidate)
    within = F.coalesce(urls.within_root(candidate, root), F.lit(False))
    above = depth < max_depth

    def decide(it: Column) -> Column:
        return F.when(it.isNull(), above & within).when(it["is_form"], F.lit(False)).otherwise(it["job_id"].isNotNull() | above)

    return urls.let(site, decide)


def merged(first: Column, second: Column, limit: int | None = None) -> Column:
    """Both lists in order, each address once, up to a limit; a limit of none or less than one is the sitemap rule."""
    both = F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))
    if limit is None:
        return both
    return F.slice(both, 1, limit) if limit > 0 else F.array().cast("array<string>")


def child_root(depth: Column, root: Column, final: Column) -> Column:
    """The root that children are scoped by: a page of depth 0 passes on its address after redirects."""
    return F.when(depth == 0, F.coalesce(final, root)).otherwise(root)

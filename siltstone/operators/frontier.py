"""The URL frontier: bounded breadth-first traversal of a link graph, and sitemap walks.

Each level reads the links, keeps those of the frontier by a semi-join, and drops what is known by an
anti-join; levels are written tables, so lineage stays short. A page counts at its smallest depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.scratch import written

SITEMAP_DOCUMENTS = 10
#: Frontiers up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: What a row of a broadcast takes besides its text, with its place in the hash table.
HASHED_BYTES = 100


def _few(nodes: DataFrame) -> DataFrame:
    """`nodes`, a written table, to be broadcast if its counted bytes are few."""
    told = nodes.agg(F.count("*"), F.sum(F.octet_length(F.col("node").cast("string")))).first()
    return F.broadcast(nodes) if told[0] * HASHED_BYTES + (told[1] or 0) <= BROADCAST_BYTES else nodes


def traverse(links: DataFrame, roots: DataFrame, max_depth: int, per_page: int | None = None, per_run: int | None = None) -> DataFrame:
    """node and depth of all nodes reached from `roots` (node) over `links` (src, dst, pos).

    `per_page` keeps the first distinct links of a page by position; `per_run` bounds all nodes,
    in order of depth, parent and position.
    """
    known = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier, total = known, known.count()
    for depth in range(1, max_depth + 1):
        # Only the frontier's links are grouped and ranked: all of them would be shuffled again at each level.
        own = links.join(_few(frontier).select(F.col("node").alias("src")), "src", "left_semi").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
        if per_page is not None:
            own = own.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("pos", "dst"))).where(F.col("n") <= per_page)
        step = own.groupBy("dst").agg(F.min(F.struct("src", "pos")).alias("via"))
        new = step.select(F.col("dst").alias("node"), "via").join(known, "node", "left_anti")
        if per_run is not None:
            new = new.orderBy("via", "node").limit(max(0, per_run - total))
        frontier = written(new.select("node", F.lit(depth).alias("depth")), "frontier")
        count = frontier.count()
        if not count:
            break
        total += count
        known = written(known.unionByName(frontier), "frontier-known")
    return known


def sitemap_walk(sitemaps: DataFrame, seeds: DataFrame, limit: int = SITEMAP_DOCUMENTS) -> DataFrame:
    """Documents of each root in order of visit: breadth first, at most `limit`, missing ones count too.

    `sitemaps` has url, is_index and locs (array); `seeds` has root, url and pos.
    """
    first = seeds.groupBy("root", "url").agg(F.min("pos").alias("pos"))
    rank = W.partitionBy("root").orderBy("pos", "url")
    seen = written(first.select("root", "url", F.row_number().over(rank).alias("visit")).where(F.col("visit") <= limit), "sitemaps")
    frontier = seen
    for _ in range(limit):
        children = frontier.join(sitemaps.where("is_index"), "url").select("root", "visit", F.posexplode("locs").alias("k", "child"))
        new = children.groupBy("root", F.col("child").alias("url")).agg(F.min(F.struct("visit", "k")).alias("at_")).join(seen, ["root", "url"], "left_anti")
        base = seen.groupBy("root").agg(F.max("visit").alias("base"))
        order = W.partitionBy("root").orderBy("at_", "url")
        new = new.join(base, "root").select("root", "url", (F.col("base") + F.row_number().over(order)).alias("visit")).where(F.col("visit") <= limit)
        frontier = written(new, "sitemaps")
        if not frontier.count():
            break
        seen = written(seen.unionByName(frontier), "sitemaps-seen")
    return seen


def sitemap_pages(found: DataFrame, limit: int | None) -> DataFrame:
    """Pages of sitemaps that may be crawled: root, url and rank, each once, in order of first place.

    `found` has root, loc and pos (place in the walk). Locations are made canonical; those of skipped
    suffixes, other origins or paths outside the root's go. `limit` bounds the pages of a root; a limit
    below one gives none.
    """
    rows = found.withColumn("url", urls.canonicalise("loc")).where(F.col("url").isNotNull() & urls.within_root("url", "root"))
    rows = rows.groupBy("root", "url").agg(F.min("pos").alias("pos"))
    if limit is not None and limit < 1:
        rows = rows.where("false")
    rank = F.row_number().over(W.partitionBy("root").orderBy("pos", "url"))
    rows = rows.select("root", "url", rank.alias("rank"))
    return rows if limit is None else rows.where(F.col("rank") <= limit)

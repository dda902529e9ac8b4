"""Groups from buckets: nodes that share keys are compared and linked, without pairs within a group.

`entries` has a row for each (key, node). Any two nodes of a key are candidates. Rounds compare each
node with a few nodes that stand for its buckets, and join what is linked into components; a bucket
whose nodes are all in one component is done. The buckets that are left are opened by the caller,
between components only, so that no candidate is left out. A group of n near copies costs n
comparisons a round and not n * n / 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import connected
from siltstone.scratch import discard, written

#: Nodes that stand for a bucket in a round.
PICKS = 3
#: Rounds go on, up to MOST_ROUNDS, while at least one of SLOW comparisons makes a link.
MOST_ROUNDS, SLOW = 6, 20
#: Lists up to this size are broadcast; longer ones are joined by shuffle.
BROADCAST_BYTES = 40 << 20
#: What a row of a broadcast takes at least, with its place in the hash table.
HASHED_BYTES = 100


def short(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df`, to be broadcast if its rows are counted and few; it must be cheap to count."""
    return F.broadcast(df) if df.count() * max(row_bytes, HASHED_BYTES) <= BROADCAST_BYTES else df


def merge(entries: DataFrame, compare: Callable[[DataFrame], DataFrame], alike: str = "true") -> tuple[DataFrame, DataFrame]:
    """Links (x, y) found in rounds, and the entries, with `component`, of buckets with several components.

    `entries` has key, node, `least` (so many buckets must agree on a pair before it is compared in a
    round), `score` (nodes of high score are compared first; both only change cost) and maybe `size` and
    `at`, which `alike`, an SQL condition, may name, also as `other.size` and `other.at`. `compare` returns
    the rows of its argument (x, y, cx, cy) that are linked.
    """
    extra = [c for c in entries.columns if c not in ("key", "node")]
    active = entries.withColumn("component", F.col("node"))
    links: DataFrame | None = None
    held: DataFrame | None = None
    for number in range(MOST_ROUNDS):
        seeds = range(PICKS * number, PICKS * number + PICKS)
        told = ["node", "component", *[c for c in ("size", "at") if c in extra]]
        # A node whose keys many others have is likely the one that the others are copies of.
        luck = [F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 20)) / (1 << 20) for seed in seeds]
        order = [-F.col("score") * (1 - 0.1 * number * luck[0]), *luck[1:]]
        picks = [F.min(F.struct(o.alias("order"), *told)) for o in order]
        buckets = active.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.array(*picks).alias("others")).where("low <> high")
        buckets = written(buckets.select("key", "others"), "buckets")
        left = written(active.join(buckets, "key"), "active")
        discard(buckets, *([held] if held is not None else []))
        held, active = left, left.drop("others")
        met = left.select("node", "component", *extra, F.posexplode("others").alias("pick", "other"))
        met = met.where("component <> other.component").where(alike)
        met = met.groupBy("node", "pick", F.col("other.node").alias("y")).agg(F.count("*").alias("n"), F.min("component").alias("cx"), F.min("other.component").alias("cy"), F.min("least").alias("least"))
        met = met.where("n >= least").groupBy("node", "pick").agg(F.max_by(F.struct("y", "cx", "cy"), F.struct("n", "y")).alias("b"))
        met = written(met.select(F.col("node").alias("x"), "b.y", "b.cx", "b.cy").distinct(), "near")
        tried = met.count()
        if not tried and links is not None:
            break
        new = written(compare(met), "new-links")
        made = new.count()
        links = new.drop("cx", "cy") if links is None else links.unionByName(new.drop("cx", "cy"))
        if not made:
            break
        joined = connected(new.select("cx", "cy")).withColumnRenamed("component", "joined")
        active = _moved(active, joined)
        if made * SLOW < tried:
            break
    return links, active


def _moved(active: DataFrame, joined: DataFrame) -> DataFrame:
    """`active` with the components that `joined` (node, joined) tells."""
    told = joined.select(F.col("node").alias("before"), "joined")
    out = active.join(short(told, 32), F.col("component") == F.col("before"), "left")
    return out.withColumn("component", F.coalesce("joined", "component")).drop("before", "joined")

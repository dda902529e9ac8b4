"""Merge-style writes as snapshots: conditional puts and updates by key, as joins.

Snapshots are immutable; each function returns the next one. Of several changes of a key the one
with the greatest order wins. Applying the same changes again gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in keys]
    top = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return top.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def insert_if_absent(snapshot: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of new keys are added, the first of each by `order`; known keys stay as they are."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])
    return snapshot.unionByName(first.select(snapshot.columns).join(snapshot.select(*keys), keys, "left_anti"))


def upsert(snapshot: DataFrame, rows: DataFrame, keys: list[str], set_once: tuple[str, ...] = ()) -> DataFrame:
    """Rows (one a key) overwrite the snapshot; `set_once` columns keep a value that is there."""
    new = rows.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"new_{c}") for c in rows.columns if c not in keys], F.lit(True).alias("is_new"))
    joined = snapshot.join(new, keys, "full_outer")
    out = []
    for c in snapshot.columns:
        if c in keys or f"new_{c}" not in new.columns:
            out.append(F.col(c))
        elif c in set_once:
            out.append(F.coalesce(F.col(c), F.col(f"new_{c}")).alias(c))
        else:
            out.append(F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(out)


def raise_mark(snapshot: DataFrame, marks: DataFrame, key: str, mark: str, carried: str) -> DataFrame:
    """`mark` and `carried` move only to a strictly later mark."""
    new = marks.groupBy(key).agg(F.max(F.struct(F.col(mark).alias("m"), F.col(carried).alias("c"))).alias("new"))
    joined = snapshot.join(new, key, "left")
    later = F.col("new.m").isNotNull() & (F.col(mark).isNull() | (F.col("new.m") > F.col(mark)))
    told = {mark: F.when(later, F.col("new.m")).otherwise(F.col(mark)), carried: F.when(later, F.col("new.c")).otherwise(F.col(carried))}
    return joined.select([told.get(c, F.col(c)).alias(c) for c in snapshot.columns])

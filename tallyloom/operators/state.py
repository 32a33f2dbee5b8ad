"""Incremental state on immutable tables: upserts, imports, resumption and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_accumulate(current: DataFrame, incoming: DataFrame, keys: list[str], add: str, keep: str) -> DataFrame:
    """Incoming rows replace current ones, but ``add`` accumulates and ``keep`` stays as it was first."""
    old = current.select(*keys, *[F.col(c).alias(f"__{c}") for c in current.columns if c not in keys], F.lit(True).alias("__old"))
    both = incoming.withColumn("__new", F.lit(True)).join(old, keys, "full")
    out = [*keys]
    for c in current.columns:
        if c in keys:
            continue
        new = F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__{c}"))
        if c == add:
            new = F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"__{c}"), F.lit(0))
        elif c == keep:
            new = F.when(F.col("__old"), F.col(f"__{c}")).otherwise(F.col(c))
        out.append(new.alias(c))
    return both.select(*out)


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and the incoming rows of new keys."""
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti").select(current.columns))


def conflicts(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ between the two: an import with any is refused."""
    rest = [c for c in current.columns if c not in keys]
    old = current.select(*keys, F.struct(*rest).alias("__old"))
    return incoming.select(*keys, F.struct(*rest).alias("__new")).join(old, keys).where(~F.col("__old").eqNullSafe(F.col("__new"))).select(*keys)


def pending(scheduled: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Scheduled keys without a terminal record."""
    return scheduled.join(done.select(*keys), keys, "left_anti")


def unlocked(assigned: DataFrame, answered: DataFrame, who: str, item: str) -> DataFrame:
    """Per reviewer: whether all that is assigned is answered."""
    hit = assigned.join(answered.select(who, item).distinct().withColumn("__hit", F.lit(1)), [who, item], "left")
    return hit.groupBy(who).agg(F.count(F.lit(1)).alias("assigned"), F.count("__hit").alias("answered")).withColumn("unlocked", F.col("assigned") == F.col("answered"))


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose values differ between two (path, value) tables."""
    b = before.select("path", F.col("value").alias("before"))
    return b.join(after.select("path", F.col("value").alias("after")), "path", "full").where(~F.col("before").eqNullSafe(F.col("after")))

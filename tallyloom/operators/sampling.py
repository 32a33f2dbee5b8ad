"""Deterministic sampling: strata, splits, round robin and draws that keep groups apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.rng import order_key


def ranked(df: DataFrame, strata: list[str], key: str, seed: int, out: str = "rank") -> DataFrame:
    """Rank from 1 of each row within its stratum, in the order of a hash of seed and key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*strata).orderBy(order_key(seed, F.col(key)), key)))


def per_cell(df: DataFrame, strata: list[str], key: str, k: int, seed: int) -> DataFrame:
    """k rows of each cell, dealt to sets A, B, ... in turn; a cell with fewer is a ValueError."""
    few = df.groupBy(*strata).count().where(F.col("count") < k).limit(1).collect()
    if few:
        raise ValueError(f"a cell has fewer than {k} rows: {few[0].asDict()}")
    out = ranked(df, strata, key, seed).where(F.col("rank") <= k)
    return out.withColumn("set", F.substring(F.lit("ABCDEFGHIJ"), F.col("rank"), F.lit(1)))


def split_half(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Each stratum alternately to explore and confirm."""
    out = ranked(df, strata, key, seed)
    return out.withColumn("split", F.when(F.col("rank") % 2 == 1, "explore").otherwise("confirm")).drop("rank")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, one of each stratum in turn: in the order of rank, then stratum."""
    return ranked(df, [stratum], key, seed).orderBy("rank", stratum).limit(n)


def group_exclusive(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """Round robin over categories, where a category's next candidate is the first whose group is still free.

    ``pool`` has id, category and group. Only the first candidate of each (category, group) can ever be drawn, so the
    rest leave before the sequential part, which then runs on one candidate per category and group in one task: this
    is the draw of an evaluation set, whose pool is the benchmark.
    """
    first = pool.withColumn("key", order_key(seed, F.col("id")))
    first = first.groupBy("category", "group").agg(F.min(F.struct("key", "id")).alias("c")).select("category", "group", "c.*")

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        queues = {c: list(g.sort_values(["key", "id"]).itertuples()) for c, g in part.groupby("category", sort=True)}
        taken, out = set(), []
        while len(out) < n and any(queues.values()):
            for c in sorted(queues):
                while queues[c] and queues[c][0].group in taken:
                    queues[c].pop(0)
                if queues[c] and len(out) < n:
                    x = queues[c].pop(0)
                    taken.add(x.group)
                    out.append((x.id, c, x.group, len(out) + 1))
        return pd.DataFrame(out, columns=["id", "category", "group", "rank"])

    return first.groupBy().applyInPandas(draw, "id bigint, category string, group bigint, rank bigint")

"""Assembly of an evaluation's item sets: draws that share occupied groups, roles, reasons and a schedule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.rng import order_key
from tallyloom.operators.ranks import global_rank

_OUT = "id bigint, category string, group bigint, n_images int, part string, role string, reason string, place bigint"


def select_sets(items: DataFrame, eval_limit: int, dev_each: int, timing_counts: list[int], seed: int) -> DataFrame:
    """Every item of ``items(id, category, group, n_images, part)`` with its role, the reason it is left out, and its
    position in the schedule: eval, dev, timing, then the rest by id.

    A group gives one item to all sets together. Of items with two images, those of part ``confirm`` go to eval, one
    category after another in turn, up to ``eval_limit``; those of ``explore`` to dev, category by category, up to
    ``dev_each``. Timing takes the lowest explore id of each image count that has a free group. Categories and items
    are drawn in the order of hashes. Reasons: ``group`` (its group was taken), ``unreached``, ``not_eligible``.

    The draw is sequential, as each choice depends on those before it. Only an item that is the first of its group in
    its queue can be chosen, so the others leave before it; what it runs on has a row per group, category and part:
    the pool of a benchmark, in one task. Roles of all other items are derived in parallel.
    """
    two = F.col("n_images") == 2
    queue = F.when(two & (F.col("part") == "confirm"), "eval").when(two & (F.col("part") == "explore"), "dev")
    keyed = items.withColumn("__k", order_key(seed, F.col("id"))).withColumn("__q", queue)
    drawn = keyed.where("__q IS NOT NULL").groupBy("__q", "category", "group").agg(F.min(F.struct("__k", "id")).alias("f")).select("__q", "category", "group", "f.id", F.col("f.__k").alias("__k"), F.lit(0).alias("n_images"))
    timed = items.where((F.col("part") == "explore") & F.col("n_images").isin(timing_counts)).groupBy("n_images", "group").agg(F.min("id").alias("id"))
    timed = timed.select(F.lit("timing").alias("__q"), F.lit("").alias("category"), "group", "id", F.lit("").alias("__k"), "n_images")
    pool = drawn.unionByName(timed)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        taken: set[int] = set()
        out: list[tuple[int, str, int]] = []

        def take(row, role: str) -> bool:
            if row.group in taken:
                return False
            taken.add(row.group)
            out.append((row.id, role, len(out) + 1))
            return True

        cats = rows[rows["__q"].isin(["eval", "dev"])][["category"]].drop_duplicates().sort_values("category")["category"].tolist()
        lines = lambda q: {c: iter(list(rows[(rows["__q"] == q) & (rows["category"] == c)].sort_values(["__k", "id"]).itertuples())) for c in cats}
        open_, n = lines("eval"), 0
        while n < eval_limit and open_:
            for c in list(open_):
                hit = next((r for r in open_[c] if n < eval_limit and take(r, "eval")), None)
                n += hit is not None
                if hit is None:
                    del open_[c]
        for c, line in lines("dev").items():
            for _ in range(dev_each):
                if next((r for r in line if take(r, "dev")), None) is None:
                    break
        for k in sorted(timing_counts):
            next((r for r in rows[(rows["__q"] == "timing") & (rows["n_images"] == k)].sort_values("id").itertuples() if take(r, "timing")), None)
        yield pd.DataFrame(out, columns=["id", "role", "place"])

    chosen = pool.withColumnRenamed("__q", "q").withColumnRenamed("__k", "k").coalesce(1).mapInPandas(lambda parts: draw(p.rename(columns={"q": "__q", "k": "__k"}) for p in parts), "id bigint, role string, place bigint")
    used = items.join(chosen.select("id"), "id", "left_semi").select("group").distinct().withColumn("__used", F.lit(True))
    all_ = items.join(chosen, "id", "left").join(used, "group", "left").withColumn("__el", queue.isNotNull())
    reason = F.when(F.col("role").isNull(), F.when(~F.col("__el"), "not_eligible").when(F.col("__used"), "group").otherwise("unreached"))
    first = F.coalesce("place", F.lit(1 << 62))
    out = all_.select("id", "category", "group", "n_images", "part", F.coalesce("role", F.lit("rest")).alias("role"), reason.alias("reason"), first.alias("__p"))
    return positions(out, ["__p", "id"]).drop("__p")


def positions(df: DataFrame, by: list[str], out: str = "position") -> DataFrame:
    """Numbers from 1 over all rows in a total order. The ranges are stored: computed twice, for the numbers and for the
    counts before them, they can be cut at different rows."""
    return global_rank(df, by, out)


def round_robin_shuffled(items: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n of ``items(id, category)`` taken from categories in turn, both in the order of hashes."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(order_key(seed, F.col("id")), "id"))
    return items.withColumn("round", rank).orderBy("round", order_key(seed, F.lit("category"), F.col("category")), "category").limit(n)


def fresh_components_first(items: DataFrame, each: int, seed: int) -> DataFrame:
    """``each`` of every category of ``items(id, category, component)``: items of different components first, then, where
    these are too few, others, marked ``collision``."""
    order = [order_key(seed, F.col("id")), F.col("id")]
    seen = F.row_number().over(Window.partitionBy("category", "component").orderBy(*order)) > 1
    marked = items.withColumn("collision", seen)
    rank = F.row_number().over(Window.partitionBy("category").orderBy("collision", *order))
    return marked.withColumn("rank", rank).where(F.col("rank") <= each)

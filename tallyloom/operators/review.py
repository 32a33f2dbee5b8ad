"""Review packets, exports and guards: what leaves the engine for people, and what must hold before it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import graph
from tallyloom.sources.staging import staged

#: Fixed value: concurrent calls must be this many times faster than sequential ones.
SPEEDUP = 1.15


def shown_order(variant: Column, n_images: Column, saved: Column) -> Column:
    """Image numbers in the order shown: the saved one, else reversed for ``reorder``, else as they are."""
    plain = F.sequence(F.lit(1), n_images)
    return F.coalesce(saved, F.when(variant == "reorder", F.reverse(plain)).otherwise(plain))


def review_packet(records: DataFrame, dataset: DataFrame) -> DataFrame:
    """One row per image of each record, in the order shown, beside the question it was asked with.

    ``records`` has id, variant and image_order (or null), ``dataset`` id, question, gold and n_images; records whose
    id the dataset lacks are left out.
    """
    met = records.join(dataset, "id")
    order = shown_order(F.col("variant"), F.col("n_images"), F.col("image_order"))
    return met.select("id", "variant", "gold", "question", F.posexplode(order).alias("at", "image")).withColumn("shown", F.col("at") + 1).drop("at")


def review_completion(rows: DataFrame, valid: str) -> DataFrame:
    """How many rows are reviewed, how many pass, and the rate in percent, null without a review."""
    cell = F.lower(F.trim(F.coalesce(valid, F.lit(""))))
    a = rows.agg(F.count_if(cell != "").alias("reviewed"), F.count(F.lit(1)).alias("total"), F.count_if(cell.isin("y", "yes", "true", "1")).alias("passed"))
    return a.withColumn("pass_rate", F.when(F.col("reviewed") > 0, 100.0 * F.col("passed") / F.col("reviewed")))


def key_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row on whether two frames may be joined by ``key`` one to one: rows, keys met, keys of one side, repeats."""
    side = lambda df, out: df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    met = side(left, "__l").join(side(right, "__r"), key, "full")
    a = met.agg(
        F.coalesce(F.sum("__l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("__r"), F.lit(0)).alias("n_right"), F.count_if(F.col("__r").isNull()).alias("only_left"),
        F.count_if(F.col("__l").isNull()).alias("only_right"), F.count_if((F.col("__l") > 1) | (F.col("__r") > 1)).alias("repeated"),
    )
    return a.withColumn("aligned", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("repeated") == 0))


def flag_problem(flag: Column, expected: Column) -> Column:
    """What is wrong with an exported truth cell: not readable, or not what the row's own fields say; else null."""
    cell = F.lower(F.trim(flag))
    value = F.when(cell.isin("1", "true"), True).when(cell.isin("0", "false"), False)
    return F.when(value.isNull(), "unreadable").when(value != expected, "disagrees")


def new_sessions(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each distinct session: what an append-unless-known history holds at the end."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row")).select(*by, "__row.*")


def concurrency_decision(runs: DataFrame) -> DataFrame:
    """``decision`` and ``speedup`` of runs with n_items, sequential and wall seconds, and failures.

    Any failure, a duration of zero, or a gain below SPEEDUP keeps calls sequential; then the speedup is null.
    """
    undefined = F.coalesce((F.col("sequential") <= 0) | (F.col("wall") <= 0), F.lit(True))
    gain = F.when(~undefined, F.col("sequential") / F.col("wall"))
    decision = F.when(F.col("failures") > 0, "failures").when(undefined, "undefined").when(gain + 1e-9 < SPEEDUP, "too slow").otherwise("selected")
    return runs.withColumn("decision", decision).withColumn("speedup", F.when(F.col("decision") == "selected", gain))


def shared_groups(items: DataFrame, key: str, values: str) -> DataFrame:
    """``(key, group)``: rows that share a value, directly or through others, are one group, named by its least key.

    ``values`` is an array. Each value links its rows to its least row, so a value of very many rows makes as many
    links as rows; rows without a value, or alone with theirs, are their own group.
    """
    long = staged(items.select(key, F.explode(F.array_distinct(values)).alias("__v")).where("__v IS NOT NULL"), "values")
    least = long.groupBy("__v").agg(F.min(key).alias("__u"))
    edges = long.join(least, "__v").where(F.col("__u") != F.col(key)).select(F.col("__u").alias("u"), F.col(key).alias("v"))
    label = graph.components(edges).select(F.col("node").alias(key), F.col("label").alias("__g"))
    return items.select(key).distinct().join(label, key, "left").select(key, F.coalesce("__g", key).alias("group"))


def dominant(rates: dict[str, Column]) -> tuple[Column, Column]:
    """Name of the highest rate and that rate; ``tie`` if several have it, ``none`` if all are zero."""
    top = F.greatest(*rates.values())
    leaders = F.filter(F.array(*[F.when(c == top, n) for n, c in rates.items()]), lambda x: x.isNotNull())
    return F.when(top == 0, "none").when(F.size(leaders) > 1, "tie").otherwise(F.get(leaders, F.lit(0))), top

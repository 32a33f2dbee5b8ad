"""Scoring of judgments: accuracy, votes, flips, consistency and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.spine import strict_sum


def is_correct(status: str = "status", pred: str = "pred", gold: str = "gold"):
    """Right iff the status is ok and prediction and gold are known and equal; missing rows count as wrong."""
    return F.coalesce((F.col(status) == "ok") & (F.col(pred) == F.col(gold)), F.lit(False))


def micro_macro(rows: DataFrame, condition: str = "condition", category: str = "category", correct: str = "correct") -> DataFrame:
    """Per condition: n, micro accuracy and the unweighted mean of the categories' accuracies."""
    cells = rows.groupBy(condition, category).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(correct).cast("long")).alias("__c"))
    return cells.groupBy(condition).agg(
        F.sum("__n").alias("n"), F.sum("__c").alias("n_correct"), (F.sum("__c") / F.sum("__n")).alias("micro"), F.avg(F.col("__c") / F.col("__n")).alias("macro")
    )


def plurality(votes: DataFrame, keys: list[str], pred: str = "pred", position: str = "position", tiebreak: str | None = None) -> DataFrame:
    """The most frequent known prediction. A tie goes to ``tiebreak`` if it is among the winners, else to the one seen
    first; without known predictions the tiebreak is the vote."""
    per = votes.groupBy(*keys, pred).agg(F.count(F.lit(1)).alias("__n"), F.min(position).alias("__at"), *([F.max(tiebreak).alias("__tie")] if tiebreak else []))
    tie = F.col("__tie") if tiebreak else F.lit(None).cast("string")
    order = F.struct(F.col(pred).isNotNull().alias("known"), F.col("__n").alias("n"), F.coalesce(F.col(pred) == tie, F.lit(False)).alias("tie"), (-F.col("__at")).alias("at"))
    best = per.groupBy(*keys).agg(F.max_by(F.coalesce(F.col(pred), tie), order).alias("vote"))
    return best


def flips(variants: DataFrame, key: str = "id", base: str = "orig") -> DataFrame:
    """Every variant but the base, beside it, with whether the prediction flipped: null and null are no flip."""
    orig = variants.where(F.col("variant") == base).select(key, F.col("pred").alias("base_pred"))
    return variants.where(F.col("variant") != base).join(orig, key).withColumn("flipped", ~F.col("pred").eqNullSafe(F.col("base_pred")))


def consistency(variants: DataFrame, key: str = "id", base: str = "orig") -> DataFrame:
    """Per item: consistent iff all predictions are alike, unknown ones counting as one value; and the share of
    variants that differ from the base."""
    known = F.coalesce("pred", F.lit("<none>"))
    per = variants.groupBy(key).agg(
        F.countDistinct(known).alias("__d"), F.count(F.lit(1)).alias("n_variants"), F.max(F.when(F.col("variant") == base, known)).alias("__base"), F.collect_list(known).alias("__all")
    )
    differ = F.size(F.filter("__all", lambda x: x != F.col("__base")))
    return per.select(key, "n_variants", (F.col("__d") == 1).alias("consistent"), (differ / F.greatest(F.lit(1), F.col("n_variants") - 1)).alias("disagreement"))


def physical_cost(calls: DataFrame) -> DataFrame:
    """Cost by kind with each cache entry counted once."""
    return calls.dropDuplicates(["key"]).groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), strict_sum("tokens").alias("tokens"), F.sum("latency").alias("latency"))


def method_cost(calls: DataFrame) -> DataFrame:
    """Cost by condition with a shared entry counted in each condition that uses it."""
    return calls.dropDuplicates(["condition", "key"]).groupBy("condition").agg(F.count(F.lit(1)).alias("calls"), strict_sum("tokens").alias("tokens"), F.sum("latency").alias("latency"))

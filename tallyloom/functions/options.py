"""Functions on arrays of four options: rotations, logits and guessing policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import jaccard, tokens

A4 = range(4)


def rotated(options: Column, shift: Column) -> Column:
    return F.array(*[F.element_at(options, ((F.lit(i) + shift) % 4 + 1).cast("int")) for i in A4])


def unrotated_letter(shown: Column, shift: Column) -> Column:
    """The original letter of the one shown; null stays null."""
    return F.substring(F.lit("ABCD"), ((F.instr(F.lit("ABCD"), shown) - 1 + shift) % 4 + 1).cast("int"), F.lit(1))


def unrotated(values: Column, shift: Column) -> Column:
    """Values in shown order, put back into original order."""
    return F.array(*[F.element_at(values, ((F.lit(j) - shift + 4) % 4 + 1).cast("int")) for j in A4])


def mapped_back(pred: Column, perm: Column) -> Column:
    """The letter at ``perm``'s place for the predicted one; null out of range."""
    at = F.instr(F.lit("ABCD"), pred)
    back = F.when((at > 0) & (at <= F.size(perm)), F.get(perm, at - 1))
    return F.when((back >= 0) & (back < 4), F.substring(F.lit("ABCD"), (back + 1).cast("int"), F.lit(1)))


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0; the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def extremum_policy(values: Column, smallest: bool = False) -> Column:
    """Equal chances for all options that are as good as the best, within 1e-8 + 1e-5 of it."""
    best = F.array_min(values) if smallest else F.array_max(values)
    hit = F.transform(values, lambda x: (F.abs(x - best) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(best)).cast("double"))
    return F.transform(hit, lambda x: x / F.aggregate(hit, F.lit(0.0), lambda a, b: a + b))


def lengths(options: Column) -> Column:
    return F.transform(options, lambda x: F.size(tokens(x)).cast("double"))


def overlaps(options: Column, stem: Column) -> Column:
    return F.transform(options, lambda x: jaccard(F.array_distinct(tokens(x)), F.array_distinct(tokens(stem))).cast("double"))


def elimination_policy(removed: Column) -> Column:
    """Equal chances for the options not removed; for all four if all are."""
    left = F.size(F.filter(removed, lambda x: ~x))
    return F.transform(removed, lambda x: F.when(left == 0, 0.25).when(x, 0.0).otherwise(F.lit(1.0) / left))


def policy_score(policy: Column, gold: Column) -> Column:
    return F.element_at(policy, F.instr(F.lit("ABCD"), gold))

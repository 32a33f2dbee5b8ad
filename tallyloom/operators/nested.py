"""Comparison of nested documents: VARIANT flattened to paths, changes between two versions, and their compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nesting(json: Column) -> Column:
    """How deep the brackets of a JSON text go, those inside strings left out."""
    bare = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.split(bare, "(?!^)"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def flattened(df: DataFrame, json: str) -> DataFrame:
    """The columns of ``df`` with ``json`` replaced by ``path`` and ``value``: one row per leaf.

    Leaves are scalars and empty containers, as JSON text, so ``null`` is a value and numbers are the same if equal. A
    path is ``$``, then ``.key`` or ``[index]`` a level; a key that is no plain name is quoted. A null text, or one that
    is no JSON or repeats a key, has no rows. Levels are opened by a table function in one pass without a shuffle, as
    many as the deepest document has, which a first pass finds.
    """
    kept = [c for c in df.columns if c != json]
    most = df.agg(F.max(nesting(F.col(json)))).first()[0] or 0
    at = df.select(*kept, F.lit("$").alias("__path"), F.try_parse_json(json).alias("__v")).where("__v IS NOT NULL")
    for _ in range(most):
        text = F.to_json("__v")
        opened = (text.startswith("{") | text.startswith("[")) & ~text.isin("{}", "[]")
        at = at.withColumn("__in", F.when(opened, F.col("__v")))
        each = df.sparkSession.tvf.variant_explode_outer(F.col("__in").outer()).select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__value"))
        name = F.when(F.col("__key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("__key")).otherwise(F.to_json(F.to_variant_object(F.array("__key"))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array("__key")))) - 2))
        step = F.when(F.col("__pos").isNull(), "").when(F.col("__key").isNotNull(), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit("["), F.col("__pos"), F.lit("]")))
        at = at.lateralJoin(each).select(*kept, F.concat("__path", step).alias("__path"), F.when(F.col("__pos").isNull(), F.col("__v")).otherwise(F.col("__value")).alias("__v"))
    return at.select(*kept, F.col("__path").alias("path"), F.to_json("__v").alias("value"))


def changes(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """``(keys, path, before, after)`` for every leaf that two versions of a document do not share.

    A side without the path is null. A leaf that becomes a container is gone, and the container's leaves are new.
    Rows are told apart by ``keys``; both versions of a row are flattened in one pass and met by one shuffle.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("json")) for s, c in (("b", before), ("a", after))])
    leaves = flattened(df.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", "s.json"), "json")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
    met = leaves.groupBy(*keys, "path").agg(of("b").alias("before"), of("a").alias("after"))
    return met.where(~F.col("before").eqNullSafe(F.col("after")))


def incompatible(changed: DataFrame, free: list[str]) -> DataFrame:
    """The changes outside the paths in ``free`` and all below them: what forbids that two versions are put together."""
    below = lambda p: (F.col("path") == p) | F.col("path").startswith(p + ".") | F.col("path").startswith(p + "[")
    allowed = F.lit(False)
    for p in free:
        allowed = allowed | below(p)
    return changed.where(~allowed)

"""Complete grids: every key of a spine, with measured rows where there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_column(spark, name: str, values: list) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def spine(ids: DataFrame, values: DataFrame) -> DataFrame:
    """Every row of ``ids`` with each of a few fixed values; the fixed list is exploded, no rows are paired off."""
    name = values.columns[0]
    fixed = [r[0] for r in values.collect()]
    return ids.withColumn(name, F.explode(F.array(*map(F.lit, fixed))))


def completed(grid: DataFrame, measured: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """``grid`` with the columns of ``measured``, filled where a key was not measured."""
    return grid.join(measured, keys, "left").fillna(fill)


def strict_sum(c: str | Column) -> Column:
    """A sum that is null if any value is null, or if there are none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when((F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count(c)), F.sum(c))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(*keys, "__row.*")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` if no key repeats; else ValueError."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key: {twice[0].asDict()}")
    return df

"""Resampling by counts: a repetition draws how often each distinct value comes, not one value a row.

Counts of a resample are multinomial, that is binomials one after the other, each given what is left. So the work grows
with repetitions and distinct values, and with the rows only by one count. Draws are hashes of their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.rng import u32, u32_grid

#: Below this expected number (of the rarer outcome) a binomial is drawn by inversion, term by term up to ``TERMS``.
SMALL, TERMS = 30, 100


def _let(x: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def uniform(*parts) -> Column:
    """A number inside (0, 1)."""
    return (u32(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def binomial(n: Column, p: Column, first: Column, second: Column) -> Column:
    """A draw from a binomial by two uniform numbers: by inversion where few are expected, else a normal number with the
    skewness corrected, rounded. Both engines compute it alike."""
    n, p = n.cast("double"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    q = F.least(p, 1 - p)
    start = F.struct(F.exp(n * F.ln(1 - q)).alias("term"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        total = a["sum"] + a["term"]
        return F.struct((a["term"] * (n - i) / (i + 1) * q / (1 - q)).alias("term"), total.alias("sum"), (a["k"] + (total < first).cast("double")).alias("k"))

    few = F.least(n, F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step, lambda a: a["k"]))
    z = F.sqrt(-2 * F.ln(first)) * F.cos(2 * F.pi() * second)
    many = F.least(n, F.greatest(F.lit(0.0), F.floor(n * q + F.sqrt(n * q * (1 - q)) * z + (1 - 2 * q) * (z * z - 1) / 6 + 0.5).cast("double")))
    rare = F.when(n * q < SMALL, few).otherwise(many)
    return F.when(p > 0.5, n - rare).otherwise(rare).cast("long")


def _repeated(df: DataFrame, reps: int) -> DataFrame:
    """A row for each repetition, dealt over all cores: the few rows of counts would leave them in a few tasks."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(n, "rep")


def means(counts: DataFrame, keys: list[str], reps: int, seed: object) -> DataFrame:
    """``(*keys, rep, mean)``: means of resamples of ``counts`` (keys, code, x, n), n rows of the value x of each code.

    ``code`` is a whole number that names a value and orders the draws.
    """
    packed = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("code", "x", "n"))).alias("__v"), F.sum("n").alias("__n"))
    drawn = _repeated(packed, reps)
    key = [F.col(k) for k in keys]

    def step(a: Column, v: Column) -> Column:
        draw = lambda side: uniform("resample", seed, *key, F.col("rep"), v["code"], side)
        k = binomial(a["left"], v["n"] / a["mass"], draw(1), draw(2))
        return _let(k, lambda k: F.struct((a["left"] - k).alias("left"), (a["mass"] - v["n"]).alias("mass"), (a["sum"] + k * v["x"]).alias("sum")))

    total = F.aggregate("__v", F.struct(F.col("__n").alias("left"), F.col("__n").alias("mass"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"] / F.col("__n"))
    return drawn.select(*keys, "rep", total.alias("mean"))


def chance_means(shapes: DataFrame, keys: list[str], reps: int, seed: object, options: int = 4) -> DataFrame:
    """``(*keys, rep, mean)``: mean scores of a policy when answers are drawn at random. ``shapes`` (keys, m, n) holds how
    many questions leave m letters tied: each scores 1 / m with probability m / options."""
    key = [F.col(k) for k in keys]
    draw = lambda side: uniform("chance", seed, *key, F.col("rep"), F.col("m"), side)
    hits = binomial(F.col("n"), F.col("m") / F.lit(float(options)), draw(1), draw(2))
    rows = _repeated(shapes, reps).withColumn("__s", hits / F.col("m"))
    return rows.groupBy(*keys, "rep").agg((F.sum("__s") / F.sum("n")).alias("mean"))


def sql_uniform(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def sql_draw(source: str, out: str, n: str, p: str, key: str) -> str:
    """CTEs for DuckDB that end in ``out``: ``source`` with ``k``, a binomial draw as ``binomial`` makes it."""
    q = "least(p_, 1 - p_)"
    term = f"CASE WHEN i > n_ THEN 0 WHEN {q} = 0 THEN (i = 0)::INT ELSE exp(lgamma(n_ + 1) - lgamma(i + 1) - lgamma(n_ - i + 1) + i * ln({q}) + (n_ - i) * ln(1 - {q})) END"
    few = f"least(n_, list_sum(list_transform(range(1, {TERMS + 1}), lambda j: (list_sum(t_[1:j]) < u_)::INT)))"
    z = "(sqrt(-2 * ln(u_)) * cos(2 * pi() * w_))"
    many = f"least(n_, greatest(0, floor(n_ * {q} + sqrt(n_ * {q} * (1 - {q})) * {z} + (1 - 2 * {q}) * ({z} * {z} - 1) / 6 + 0.5)))"
    return f"""{out}a AS (SELECT *, ({n})::DOUBLE AS n_, least(1, greatest(0, ({p})::DOUBLE)) AS p_, {sql_uniform(f"{key} || '|1'")} AS u_, {sql_uniform(f"{key} || '|2'")} AS w_ FROM {source}),
{out}b AS (SELECT *, CASE WHEN n_ * {q} < {SMALL} THEN list_transform(range({TERMS}), lambda i: {term}) END AS t_ FROM {out}a),
{out}c AS (SELECT *, CASE WHEN t_ IS NOT NULL THEN {few} ELSE {many} END AS r_ FROM {out}b),
{out} AS (SELECT * EXCLUDE (n_, p_, u_, w_, t_, r_), CASE WHEN p_ > 0.5 THEN n_ - r_ ELSE r_ END AS k FROM {out}c)"""


def drawn_hits(df: DataFrame, key: str, answer: str, name: str, reps: int, options: int = 4) -> DataFrame:
    """``(rep, hits)``: how many rows' ``answer``, a number below ``options``, is the one drawn for them in each repetition.

    The draw is ``u32(name, rep, key)`` modulo ``options``. Rows and repetitions are never joined: a task makes the draws
    of its rows, some 30,000 at a time, and gives one sum a repetition. Rows are spread by key, 4,096 a task.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(answer).cast("int").alias("answer")).where("key IS NOT NULL AND answer IS NOT NULL")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = np.zeros(reps, np.int64)
        heads = [f"{name}|{r}|".encode() for r in range(reps)]
        for p in parts:
            tails = p["key"].str.encode("utf-8")
            for _, same in p.assign(key=tails).groupby(tails.str.len()):
                want, keys = same["answer"].to_numpy(np.uint32), same["key"].tolist()
                step, at = max(1, 32_768 // len(keys)), 0
                while at < reps:
                    to = at + 1
                    while to < min(reps, at + step) and len(heads[to]) == len(heads[at]):
                        to += 1
                    drawn = u32_grid(heads[at:to], keys) % np.uint32(options)
                    hits[at:to] += (drawn == want).sum(axis=1)
                    at = to
        if hits.any():
            yield pd.DataFrame({"rep": np.arange(reps), "hits": hits})

    tasks = rows.count() // 4096 + 1
    made = rows.repartition(tasks, "key").mapInPandas(count, "rep long, hits long")
    return made.groupBy("rep").agg(F.sum("hits").alias("hits"))

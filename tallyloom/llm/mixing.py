"""Mixing sources to target weights, with DataFrame functions only.

Sizes are added up per source, targets derived by weight under a cap, and each document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy whose probability is the fraction of the rate. A source's seed is the one
of ``SEEDS`` whose draws come nearest to its target, so that small sources with few documents stay near theirs too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD_PATTERN, id_text, staged, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEEDS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) from the id as text and a seed; equal ids draw alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"mix|{seed}|"), id_text(doc_id))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: ``source``, ``source_size`` and ``target``.

    ``sizes`` has ``source`` and ``size``. Sources by code point, null last, take the weights in turn. Together the
    targets are ``share`` of all sizes; one above ``cap`` times its size stops there and the excess is shared anew
    by weight. The fixed point is target = min(cap * size, level * weight), and the level follows from one sort by
    cap * size / weight. The frame it sorts has one row per source, summed before.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.hex(F.col("source").cast("binary")))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__mx_k") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("__mx_k", F.row_number().over(order)).withColumn("__mx_w", w).withColumn("__mx_cap", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy(F.col("__mx_cap") / F.col("__mx_w"), "__mx_k")
    below, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("__mx_cap").over(below), F.lit(0))) / F.sum("__mx_w").over(rest)
    found = ranked.withColumn("__mx_l", level).withColumn("__mx_open", F.col("__mx_l") * F.col("__mx_w") <= F.col("__mx_cap"))
    final = F.first(F.when(F.col("__mx_open"), F.col("__mx_l")), ignorenulls=True).over(every)
    return found.withColumn("__mx_level", final).select(
        "source",
        "source_size",
        F.least(F.col("__mx_cap").cast("double"), F.coalesce(F.col("__mx_level") * F.col("__mx_w"), F.col("__mx_cap").cast("double"))).alias("target"),
    )


def source_plan(sizes: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """One stored row per source: ``source``, ``source_size``, ``target``, ``rate`` and the ``seed`` of its draws.

    ``sizes`` has doc_id, source and size. The sums of all seeds' draws are made in the tasks that read the documents,
    before any shuffle, so a hot source adds no load to one task.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = staged(source_targets(sizes.select("source", "size")).withColumn("rate", rate), "targets")
    joined = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    off = [F.abs(F.sum(F.col("size") * _take(i)) - F.first("target")) for i in range(seeds)]
    trials = joined.groupBy("source").agg(F.array(*off).alias("__mx_off"))
    best = trials.select("source", (F.array_position("__mx_off", F.array_min("__mx_off")) - 1).cast("int").alias("seed"))
    return staged(targets.join(best, targets["source"].eqNullSafe(best["source"])).drop(best["source"]), "plan")


def _take(seed: int, rate: str = "rate") -> Column:
    return (F.floor(rate) + (draw(seed) < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


def copies(docs: DataFrame, plan: DataFrame, seeds: int = SEEDS, out: str = "copies") -> DataFrame:
    """``docs`` with the struct ``out``: source_size, target and n, how often each row is taken.

    The plan is a stored table of one row per source: Spark broadcasts it where its files are small and splits a hot
    source's rows where not. A source without words, or with a target of 0, gives no copies.
    """
    p = plan.select(F.col("source").alias("__mx_source"), F.col("source_size").alias("__mx_size"), F.col("target").alias("__mx_target"), F.col("rate").alias("__mx_rate"), F.col("seed").alias("__mx_seed"))
    n = F.coalesce(*[F.when(F.col("__mx_seed") == i, _take(i, "__mx_rate")) for i in range(seeds)], F.lit(0)).cast("long")
    got = F.struct(F.col("__mx_size").alias("source_size"), F.col("__mx_target").alias("target"), n.alias("n"))
    joined = docs.join(p, docs["source"].eqNullSafe(p["__mx_source"]), "left")
    return joined.withColumn(out, got).drop(*p.columns)


def mix(docs: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is taken, columns unchanged.

    Null texts have size 0 and, like all rows, follow their source's rate. Repeated rows draw alike. An empty table
    gives an empty one. Sizes and draws are computed before texts are repeated.
    """
    plan = source_plan(staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes"), seeds)
    taken = copies(docs, plan, seeds, "__mx_taken")
    return taken.withColumn("__mx_i", F.explode(F.array_repeat(F.lit(0), F.col("__mx_taken.n").cast("int")))).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the words each of all documents gives to the mix."""
    # Words are counted once: the plan and the result read the stored sizes.
    docs = staged(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out = copies(docs, source_plan(docs))
    return out.select("doc_id", "source", "size", "copies.source_size", "copies.target", (F.col("size") * F.col("copies.n")).alias("taken"))


_TAKE = "(floor(rate) + CASE WHEN ('0x' || substr(md5('mix|' || {i} || '|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT"
_OFF = ", ".join(f"abs(sum(size * {_TAKE.format(i=i)})::DOUBLE - min(target))" for i in range(SEEDS))
MIX_CTES = rf"""
d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {{docs}}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM s),
v AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM k),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(w) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM v),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT min_by(lv, (cap::DOUBLE / w, k)) FROM l WHERE lv * w <= cap) * w, cap::DOUBLE)) AS target FROM l),
j AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT source, [{_OFF}] AS off FROM j GROUP BY source),
e AS (SELECT source, list_position(off, list_min(off)) - 1 AS seed FROM o),
x AS (SELECT j.*, CASE seed {" ".join(f"WHEN {i} THEN {_TAKE.format(i=i)}" for i in range(SEEDS))} END AS copies
      FROM j JOIN e ON j.source IS NOT DISTINCT FROM e.source)"""
ORACLE = f"WITH {MIX_CTES.format(docs='documents')}\nSELECT doc_id, source, size, source_size, target, (size * copies)::BIGINT AS taken FROM x"

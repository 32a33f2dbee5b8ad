"""Connected components of an edge table by minimum label, with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.staging import scratch, staged


def components(edges: DataFrame, held: Callable[[DataFrame, str], DataFrame] | None = None, unique: bool = False) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``; the label is the smallest node that can be reached.

    Nodes may be of any type that has an order; edges with a null end are none. Each round replaces a label by its
    label's label and then by the least label among the neighbours, so the number of rounds grows with the logarithm
    of the longest path. Labels only fall, and the rounds end when the sum of their hashes stays. Rounds are written
    to the shared folder. Both inputs of every join are stored tables, so that Spark can split the rows of a node with
    very many edges.

    A caller with a ``scratch`` of its own passes its ``held``: the last round is then the result, without a copy, and
    goes with that scratch. ``unique`` says that no edge is repeated often, which saves a shuffle of them.
    """
    if held is None:
        with scratch(edges.sparkSession) as own:
            return staged(_rounds(edges, own, unique), "components")
    return _rounds(edges, held, unique)


def _rounds(edges: DataFrame, held: Callable[[DataFrame, str], DataFrame], unique: bool) -> DataFrame:
    # Both directions of a row at once: what makes the edges is evaluated once.
    both = edges.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    e = held(both if unique else both.distinct(), "edges")
    now = held(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    before = None
    while True:
        total = now.agg(F.sum(F.xxhash64("label").cast("decimal(38,0)"))).first()[0]
        if total == before or total is None:
            return now
        before = total
        up = now.select(F.col("node").alias("label"), F.col("label").alias("__top"))
        jumped = held(now.join(up, "label").select("node", F.col("__top").alias("label")), "jumped")
        told = e.join(jumped.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label")
        now = held(jumped.unionByName(told).groupBy("node").agg(F.min("label").alias("label")), "labels")

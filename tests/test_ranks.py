import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.selection import positions
from tallyloom.operators.similarity import permuted_labels
from tallyloom.operators.stats import auroc, average_ranks
from tallyloom.plans import ORACLES, statistics


def test_average_ranks_match_pandas_with_ties_groups_and_nulls(spark):
    r = np.random.default_rng(2)
    p = pd.DataFrame({"id": range(600), "g": r.choice(["a", "b", "b", "b"], 600), "x": r.integers(0, 25, 600).astype(float)})
    d = spark.createDataFrame(p).repartition(5)
    for keys in ([], ["g"]):
        want = (p.groupby("g").x if keys else p.x).rank()
        got = {x["id"]: x["r"] for x in average_ranks(d, "x", "r", keys).collect()}
        assert got == dict(zip(p.id, want))
    # A null value has no rank.
    assert average_ranks(d.withColumn("x", F.when(F.col("id") > 9, F.col("x"))), "x", "r").count() == 590
    assert average_ranks(d.limit(0), "x", "r", ["g"]).count() == 0


def test_auroc_matches_pairs(spark):
    r = np.random.default_rng(3)
    p = pd.DataFrame({"g": r.integers(0, 3, 300), "s": r.integers(0, 12, 300), "y": r.integers(0, 2, 300)})
    got = {x["g"]: x["auroc"] for x in auroc(spark.createDataFrame(p), "s", "y", ["g"]).collect()}
    for g, q in p.groupby("g"):
        pos, neg = q.s[q.y == 1].to_numpy()[:, None], q.s[q.y == 0].to_numpy()[None, :]
        assert abs(got[g] - ((pos > neg) + (pos == neg) / 2).mean()) < 1e-12


def test_each_repetition_deals_the_same_labels(spark):
    labels = spark.createDataFrame([(3 * k, "abc"[k % 3]) for k in range(101)], "id long, label string").repartition(4)
    got = permuted_labels(labels, 20, 5).toPandas()
    want = sorted(x["label"] for x in labels.collect())
    assert got.groupby("rep").label.apply(lambda x: sorted(x) == want).all() and not got.duplicated(["rep", "id"]).any()
    orders = got.sort_values("id").groupby("rep").label.apply("".join)
    assert len(orders) == 20 and orders.nunique() == 20


def test_positions_do_not_depend_on_where_ranges_are_cut(spark):
    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.shuffle.partitions"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in zip(keys, ("40000", "false", "20000", "12")):
            spark.conf.set(k, v)
        d = spark.range(6000).select((F.col("id") * 7919 % 6007).alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = [(x["id"], x["position"]) for x in positions(d, ["id"]).select("wide", "id", "position").collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [p for _, p in sorted(got)] == list(range(1, 6001))


def test_spearman_query_as_its_sql_when_p_is_tiny_or_values_are_missing(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    near = [(i, "\n" * (i + i % 5), 10 * i) for i in range(2500)]
    missing = [(i, None if i % 4 == 0 else "\n" * (i * 37 % 101), None if i % 7 == 0 else i) for i in range(300)]
    for name, rows in (("near", near), ("missing", missing)):
        spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
        assert [tuple(r) for r in statistics.spearman(spark, f"{tmp_path}/{name}").collect()] == con.execute(ORACLES["spearman"]).fetchall()

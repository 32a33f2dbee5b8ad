"""Draws by counts have the distributions of draws row by row."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rng
from tallyloom.operators import resampling as rs


def test_binomials_have_their_mean_and_variance(spark):
    for n, p in ((10, 0.3), (40, 0.9), (5000, 0.001), (5000, 0.25), (2000, 0.97), (7, 1.0), (7, 0.0), (0, 0.4)):
        d = spark.range(20_000).select(rs.binomial(F.lit(n), F.lit(p), rs.uniform("a", F.col("id")), rs.uniform("b", F.col("id"))).alias("k")).agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
        var = n * p * (1 - p)
        assert abs(d[0] - n * p) <= 5 * (var / 20_000) ** 0.5 + 1e-9, (n, p)
        assert abs(d[1] - var) <= 0.06 * var + 1e-9, (n, p)
        assert 0 <= d[2] <= d[3] <= n


def test_means_are_those_of_a_bootstrap(spark):
    counts = spark.createDataFrame([("a", 0, 0.0, 700), ("a", 6, 0.5, 100), ("a", 12, 1.0, 200), ("b", 12, 1.0, 50)], "g string, code int, x double, n long")
    got = rs.means(counts, ["g"], 4000, 3)
    a = np.array([r["mean"] for r in got.where("g = 'a'").collect()])
    x = np.repeat([0.0, 0.5, 1.0], [700, 100, 200])
    rng = np.random.default_rng(0)
    want = rng.choice(x, (4000, 1000)).mean(1)
    assert len(a) == 4000 and abs(a.mean() - x.mean()) < 0.002 and abs(a.std() / want.std() - 1) < 0.06
    assert np.allclose(np.percentile(a, [2.5, 97.5]), np.percentile(want, [2.5, 97.5]), atol=0.004)
    assert got.where("g = 'b' AND mean <> 1").count() == 0


def test_chance_scores(spark):
    shapes = spark.createDataFrame([("p", 1, 300), ("p", 2, 100), ("p", 4, 50)], "policy string, m int, n long")
    a = np.array([r["mean"] for r in rs.chance_means(shapes, ["policy"], 4000, 1).collect()])
    # Every question scores a quarter on average; one that leaves all four letters tied always does.
    sd = (300 * 3 / 16 + 100 * (0.5 * 0.25 - 1 / 16)) ** 0.5 / 450
    assert len(a) == 4000 and abs(a.mean() - 0.25) < 0.002 and abs(a.std() / sd - 1) < 0.06


def test_grid_of_hashes_is_md5():
    for heads, tails in (([b"null|7|", b"null|9|"], [b"12", b"-4", b"99"]), ([b""], [b"abcd"]), ([b"x" * 30, b"y" * 30], [b"z" * 25]), ([b"abc"], [b""])):
        want = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads]
        assert rng.u32_grid(heads, tails).tolist() == want
    with pytest.raises(ValueError):
        rng.u32_grid([b"x" * 30], [b"y" * 26])


def test_drawn_hits_are_those_of_single_draws_and_quick(spark):
    keys = [None, 5, -17, 123456789, 9, 10, *range(1000, 1040)]
    d = spark.createDataFrame([(k, None if i == 3 else i % 4) for i, k in enumerate(keys)], "id long, answer int")
    want = d.select("answer", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("rep"), "id").where("id IS NOT NULL").where(rng.u32("null", F.col("rep"), F.col("id")) % 4 == F.col("answer")).groupBy("rep").count()
    assert {r[0]: r[1] for r in rs.drawn_hits(d, "id", "answer", "null", 120).collect() if r[1]} == {r[0]: r[1] for r in want.collect()}
    many = spark.range(100_000, 104_000).withColumn("answer", (F.col("id") % 4).cast("int"))
    start = time.perf_counter()
    got = rs.drawn_hits(many, "id", "answer", "null", 2000).agg(F.sum("hits")).first()[0]
    assert abs(got / 8e6 - 0.25) < 0.001 and time.perf_counter() - start < 60

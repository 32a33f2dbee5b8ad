"""Operators on hand-computed rows."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import options as op, rng, text as tx
from tallyloom.operators import renderings, evidence, graph, sampling, scoring, similarity, spine, state, stats
from tallyloom.sources import readers, sinks


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_hash_numbers(spark):
    import hashlib

    r = one(spark, rng.u32("boot", 1, F.lit(7)), rng.letter("x", 3))
    assert r["c0"] == int(hashlib.md5(b"boot|1|7").hexdigest()[:8], 16) and r["c1"] in "ABCD"


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.20)], "name string, p double")
    got = {r["name"]: r["p_holm"] for r in stats.holm(df, "p", "name").collect()}
    assert all(math.isclose(got[k], v) for k, v in {"a": 0.03, "b": 0.06, "c": 0.20}.items())


def test_auroc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)], "s double, y int")
    assert stats.auroc(df, "s", "y").first()["auroc"] == 1.0
    assert stats.auroc(df.where("y = 1"), "s", "y").first()["auroc"] is None
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0)], "s double, y int")
    assert stats.auroc(ties, "s", "y").first()["auroc"] == 0.5


@pytest.mark.parametrize(("b", "c", "p"), [(23, 21, 0.880395821280672), (8, 5, 0.581054687), (1, 1, 1.0), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p):
    df = spark.createDataFrame([(b, c)], "b long, c long")
    assert math.isclose(stats.mcnemar(df, "b", "c").first()["p_value"], p, rel_tol=1e-6)


def test_binomial(spark):
    df = spark.createDataFrame([(0, 29)], "k long, n long")
    assert math.isclose(stats.binomial_less(df, "k", "n").first()["p_value"], 0.75**29, rel_tol=1e-9)


def test_spearman_and_line(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 20.0), (3.0, 5.0), (None, 1.0)], "x double, y double")
    r = stats.spearman(df, "x", "y").first()
    x, y = np.array([1, 2.5, 2.5, 4]), np.array([2, 3.5, 3.5, 1])
    assert r["n"] == 4 and math.isclose(r["spearman_rho"], np.corrcoef(x, y)[0, 1], abs_tol=1e-9)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert stats.line(flat, "x", "y").first()[:2] == (0.0, 3.0)


def test_bootstrap_keeps_strata(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 0.0)], "g string, id long, x double")
    assert {round(r["mean"], 9) for r in stats.bootstrap_means(df, 30, 0, ["g"]).collect()} == {round(2 / 3, 9)}


def test_policies(spark):
    a = F.array(*map(F.lit, ["red chair", "blue table", "lamp", "green sofa"]))
    r = one(spark, op.extremum_policy(op.lengths(a)), op.extremum_policy(op.lengths(a), smallest=True), op.extremum_policy(op.overlaps(a, F.lit("Where is the chair?"))))
    assert np.allclose(r["c0"], [1 / 3, 1 / 3, 0, 1 / 3]) and r["c1"] == [0, 0, 1, 0] and r["c2"] == [1, 0, 0, 0]
    gone = F.array(*map(F.lit, [False, True, True, False]))
    r = one(spark, op.elimination_policy(gone), op.elimination_policy(F.array(*[F.lit(True)] * 4)), op.mapped_back(F.lit("A"), F.array(*map(F.lit, [2, 0, 3, 1]))), op.softmax(F.array(F.lit(0.0), F.lit(0.0))), op.policy_score(F.array(*map(F.lit, [0.1, 0.2, 0.3, 0.4])), F.lit("C")))
    assert r["c0"] == [0.5, 0, 0, 0.5] and r["c1"] == [0.25] * 4 and r["c2"] == "C" and r["c3"] == [0.5, 0.5] and r["c4"] == 0.3


def test_mirror_and_tokens(spark):
    r = one(spark, tx.mirrored(F.lit("Left, rightmost, clockwise, and counter-clockwise.")), tx.tokens(F.lit("Front-left, 60 degrees!")), tx.slug(F.lit("a b/c")), tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert r["c0"] == "Right, leftmost, counterclockwise, and clockwise." and r["c1"] == ["front", "left", "60", "degrees"] and r["c2"] == "a_b_c" and r["c3"] == 0


def test_votes_and_flips(spark):
    v = spark.createDataFrame([(1, "orig", "A", 0), (1, "m", None, 1), (1, "r", "B", 2), (1, "s", "B", 3), (2, "orig", None, 0), (2, "m", None, 1)], "id int, variant string, pred string, position int")
    assert {r["id"]: r["vote"] for r in scoring.plurality(v, ["id"]).collect()} == {1: "B", 2: None}
    assert {(r["id"], r["variant"]): r["flipped"] for r in scoring.flips(v).collect()} == {(1, "m"): True, (1, "r"): True, (1, "s"): True, (2, "m"): False}
    c = {r["id"]: (r["consistent"], r["disagreement"]) for r in scoring.consistency(v).collect()}
    assert c == {1: (False, 1.0), 2: (True, 0.0)}


def test_known_scores_and_costs(spark):
    rows = [(1, "raw", "x", True), (2, "raw", "x", True), (3, "raw", "y", False)]
    r = scoring.micro_macro(spark.createDataFrame(rows, "id int, condition string, category string, correct boolean")).first()
    assert math.isclose(r["micro"], 2 / 3) and r["macro"] == 0.5
    calls = []
    for i in range(3):
        calls += [("raw", f"r{i}", "raw_answer", 10, 0.1)]
        for m, t in (("flat", 20), ("graph", 25)):
            calls += [(m, f"e{i}", "extract", 100, 1.0), (m, f"{m}{i}", f"{m}_answer", t, 0.2)]
    df = spark.createDataFrame(calls, "condition string, key string, kind string, tokens long, latency double")
    assert {r["condition"]: (r["calls"], r["tokens"]) for r in scoring.method_cost(df).collect()} == {"raw": (3, 30), "flat": (6, 360), "graph": (6, 375)}
    assert sum(r["calls"] for r in scoring.physical_cost(df).collect()) == 12


def test_strict_sum_and_unique(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, x long")
    assert {r["k"]: r["s"] for r in df.groupBy("k").agg(spine.strict_sum("x").alias("s")).collect()} == {"a": None, "b": 2}
    assert df.where("false").agg(spine.strict_sum("x").alias("s")).first()["s"] is None
    with pytest.raises(ValueError, match="duplicate"):
        spine.assert_unique(df, ["k"])


def test_components_of_chain_and_cycle(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (41, 42), (42, 40), (50, 50)], "u long, v long")
    got = {r["node"]: r["label"] for r in graph.components(df).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (40, 41, 42)} == {40} and 50 not in got


def test_blocked_similarity_equals_all_pairs(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(90, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    old, similarity.BLOCK = similarity.BLOCK, 25
    try:
        pairs = {(x["a"], x["b"]) for x in similarity.threshold_pairs(df, 0.5).collect()}
        near = {}
        for x in similarity.nearest(df, 3).collect():
            near.setdefault(x["id"], []).append((x["rank"], x["other"]))
    finally:
        similarity.BLOCK = old
    s = v @ v.T
    assert pairs == {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.5}
    for i in range(90):
        want = sorted((j for j in range(90) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:3]
        assert [o for _, o in sorted(near[i])] == want


def test_group_exclusive_draw(spark):
    pool = spark.createDataFrame([(i, f"c{i % 3}", i // 4) for i in range(60)], "id long, category string, group long")
    got = sampling.group_exclusive(pool, 12, 0).collect()
    assert len(got) == 12 and len({x["group"] for x in got}) == 12 and len({x["category"] for x in got}) == 3
    assert sampling.group_exclusive(pool, 100, 0).count() == 15
    with pytest.raises(ValueError, match="fewer"):
        sampling.per_cell(pool, ["group"], "id", 9, 0)


def test_upsert_and_conflicts(spark):
    a = spark.createDataFrame([("r", 1, 5.0, "A", 10), ("r", 2, 1.0, "B", 11)], "who string, item int, seconds double, answer string, created int")
    b = spark.createDataFrame([("r", 1, 2.0, "C", 99), ("s", 1, 4.0, "D", 98)], a.schema)
    got = {(x["who"], x["item"]): tuple(x)[2:] for x in state.upsert_accumulate(a, b, ["who", "item"], "seconds", "created").collect()}
    assert got == {("r", 1): (7.0, "C", 10), ("r", 2): (1.0, "B", 11), ("s", 1): (4.0, "D", 98)}
    assert [tuple(x) for x in state.conflicts(a, b, ["who", "item"]).collect()] == [("r", 1)]


def test_evidence_repair_and_render(spark):
    from tallyloom.plans.graphs import inventories

    df = evidence.parsed(spark.createDataFrame([x[:3] for x in inventories()], "id int, text string, n_images int"))
    fixed = {x["id"]: x["e"][0]["cross_view"] for x in df.where("id IN (1, 13)").select("id", evidence.repaired().alias("e")).collect()}
    assert fixed[13]["uncertainty"] == "medium" and fixed[1] is not None
    flat = renderings.with_facts(df.where("id = 1")).select(renderings.flat(F.col("facts"))).first()[0].split("\n")
    assert flat[1] == "Query frame: camera:cam3 (basis: asked from the stove)." and flat[-2:] == ["[u1] Unknown: whether the stove is on.", ""]
    assert '[e4] e4 is an object labeled "steel kettle"; it is the same entity across views (uncertainty low).' in flat
    assert evidence.coverage(df.where("id = 15")).first()["n_entities"] is None


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 0.1, None), (2, None, 2.0, "x")], "id int, ok boolean, v double, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = readers.contract_csv(spark, str(tmp_path / "c"), ["id", "ok", "v", "t"])
    assert sorted(tuple(r) for r in back.collect()) == [("1", "true", "0.1", None), ("2", None, "2.0", "x")]
    with pytest.raises(ValueError, match="header"):
        readers.contract_csv(spark, str(tmp_path / "c"), ["id"])
    sinks.write_jsonl(df, str(tmp_path / "j"))
    (tmp_path / "j" / "part-broken.json").write_text("{broken\n\n")
    assert readers.jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "j"), df.schema, "fail").collect()
    assert df.select(sinks.canonical_json(["v", "id", "t"]).alias("j")).first()["j"] == '{"id":1,"t":null,"v":0.1}'
    with pytest.raises(ValueError, match="missing"):
        readers.required(df, ["id", "nope"])
    assert "| 2 |" in sinks.markdown(df.select("id"))
    assert os.path.isdir(tmp_path / "c")


def test_ami_and_student_t(spark):
    def ami(a, b):
        return stats.adjusted_mutual_information(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first()["ami"]

    assert math.isclose(ami([0, 0, 1, 1], [5, 5, 3, 3]), 1, abs_tol=1e-9) and ami([0, 0, 0, 0], [1, 1, 1, 1]) == 1 and math.isclose(ami([0, 0, 0, 0], [0, 1, 2, 3]), 0, abs_tol=1e-9)
    a, b = [0, 0, 0, 1, 1, 2, 2, 2, 2, 1], [0, 0, 1, 1, 1, 2, 2, 0, 2, 2]

    def mi(x, y):
        n = len(x)
        return sum(x_y / n * math.log(n * x_y / (x.count(i) * y.count(j))) for i in set(x) for j in set(y) if (x_y := sum(p == i and q == j for p, q in zip(x, y))))

    rng_ = np.random.default_rng(0)
    chance = np.mean([mi(a, rng_.permutation(b).tolist()) for _ in range(20000)])
    want = (mi(a, b) - chance) / ((mi(a, a) + mi(b, b)) / 2 - chance)
    assert abs(ami(a, b) - want) < 0.01
    got = one(spark, stats.t_two_sided(F.lit(2.0), F.lit(10)), stats.t_two_sided(F.lit(-12.706204736), F.lit(1)), stats.t_two_sided(F.lit(1.959963985), F.lit(10_000_000)), stats.t_two_sided(F.lit(0.0), F.lit(5)))
    assert np.allclose(list(got), [0.0733880, 0.05, 0.05, 1.0], atol=1e-5)


def test_selection_keeps_groups_apart(spark):
    from tallyloom.operators import selection

    rows = [(i, f"c{i % 3}", i // 3, 2 + i % 4, "explore" if i % 2 else "confirm") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, category string, group long, n_images int, part string")
    got = {x["id"]: x for x in selection.select_sets(df, 9, 2, [2, 3, 9], 0).collect()}
    assert len(got) == 90 and sorted(x["position"] for x in got.values()) == list(range(1, 91))
    role = lambda r: [x for x in got.values() if x["role"] == r]
    assert len(role("eval")) == 9 and {x["part"] for x in role("eval")} == {"confirm"} and {x["n_images"] for x in role("eval")} == {2}
    groups = [x["group"] for r in ("eval", "dev", "timing") for x in role(r)]
    assert len(groups) == len(set(groups)) and {x["part"] for x in role("dev") + role("timing")} <= {"explore"}
    assert len(role("timing")) == 1 and role("timing")[0]["n_images"] == 3  # no free explore item has 2, none has 9
    order = {"eval": 0, "dev": 1, "timing": 2, "rest": 3}
    by = [order[x["role"]] for x in sorted(got.values(), key=lambda x: x["position"])]
    assert by == sorted(by) and all((x["reason"] is None) == (x["role"] != "rest") for x in got.values())


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,v\n1,2.5\n2,x\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.typed_csv(spark, str(tmp_path / "t.csv"), "id int, v double").collect()
    (tmp_path / "t.csv").write_text("id,v\n1,2.5\n2,\n")
    assert [tuple(r) for r in readers.typed_csv(spark, str(tmp_path / "t.csv"), "id int, v double").collect()] == [(1, 2.5), (2, None)]

"""Review packets, guards and groups on hand-made rows: nulls, empties, ties and repeats."""

from pyspark.sql import functions as F

from tallyloom.operators import review


def test_shown_order_falls_back(spark):
    d = spark.createDataFrame([(1, "q", "A", 3)], "id long, question string, gold string, n_images int")
    r = spark.createDataFrame([(1, "reorder", [2, 3, 1]), (1, "reorder", None), (1, "mirror", None), (9, "mirror", None)], "id long, variant string, image_order array<int>")
    got = [(x.variant, x.shown, x.image) for x in review.review_packet(r, d).collect()]
    assert sorted(got) == sorted(
        [("reorder", 1, 2), ("reorder", 2, 3), ("reorder", 3, 1), ("reorder", 1, 3), ("reorder", 2, 2), ("reorder", 3, 1), ("mirror", 1, 1), ("mirror", 2, 2), ("mirror", 3, 3)]
    )


def test_completion_without_reviews(spark):
    rows = spark.createDataFrame([(None,), ("",), (" ",)], "valid string")
    assert tuple(review.review_completion(rows, "valid").first()) == (0, 3, 0, None)
    rows = spark.createDataFrame([(" Y ",), ("no",), ("1",), (None,)], "valid string")
    assert tuple(review.review_completion(rows, "valid").first()) == (3, 4, 2, 100.0 * 2 / 3)
    assert tuple(review.review_completion(rows.where("false"), "valid").first()) == (0, 0, 0, None)


def test_key_alignment(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    assert review.key_alignment(a, a, "k").first().aligned
    assert not review.key_alignment(a, a.unionByName(a), "k").first().aligned
    assert not review.key_alignment(a, a.where("k = 1"), "k").first().aligned
    empty = review.key_alignment(a.where("false"), a.where("false"), "k").first()
    assert (empty.n_left, empty.n_right, empty.aligned) == (0, 0, True)


def test_flag_problem(spark):
    rows = spark.createDataFrame([("1", True), ("False ", False), ("TRUE", False), ("2", True), (None, False)], "f string, e boolean")
    got = [r.p for r in rows.select(review.flag_problem(F.col("f"), F.col("e")).alias("p")).collect()]
    assert got == [None, None, "disagrees", "unreadable", "unreadable"]


def test_concurrency_decision(spark):
    runs = spark.createDataFrame([(1, 10.0, 5.0), (0, 10.0, 0.0), (0, 10.0, None), (0, 11.4, 10.0), (0, 11.5, 10.0)], "failures long, sequential double, wall double")
    got = [(r.decision, r.speedup) for r in review.concurrency_decision(runs).collect()]
    assert got == [("failures", None), ("undefined", None), ("undefined", None), ("too slow", None), ("selected", 1.15)]


def test_groups_join_through_others(spark):
    items = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b", None]), (4, None), (5, []), (6, [None]), (7, ["c"]), (7, ["c"]), (8, ["d", "d"])], "id long, images array<string>")
    got = {r.id: r.group for r in review.shared_groups(items, "id", "images").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert review.shared_groups(items.where("false"), "id", "images").count() == 0


def test_sessions_keep_the_first(spark):
    rows = spark.createDataFrame([("m", "a", 2), ("m", "a", 1), ("m", None, 3), ("m", None, 4)], "backend string, manifest string, at long")
    got = sorted(((r.backend, r.manifest, r["at"]) for r in review.new_sessions(rows, ["backend", "manifest"], "at").collect()), key=str)
    assert got == sorted([("m", "a", 1), ("m", None, 3)], key=str)


def test_dominant(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.5, 0.5), (0.2, 0.7)], "a double, b double")
    name, top = review.dominant({"a": F.col("a"), "b": F.col("b")})
    assert [tuple(r) for r in rows.select(name, top).collect()] == [("none", 0.0), ("tie", 0.5), ("b", 0.7)]

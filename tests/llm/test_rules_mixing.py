import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing, quality_rules as qr

SPACE = " \t\n\x0b\x0c\r"


def split_words(t):
    out, w = [], ""
    for c in (t or "") + " ":
        if c in SPACE:
            if w:
                out.append(w)
            w = ""
        else:
            w += c
    return out


def brute(t):
    t = t or ""
    w = split_words(t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if split_words(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "the cat & the dog | sat # here\nthe cat & the dog | sat # here\n\n \nend\x0bof\x0cit\r\nend",
    "ünï cödé 𝒳 words stay together", "p q r s t u v w x y z " * 3 + "p q r s t u v w", "line\n" * 50, "a b c",
]


def test_measures_match_brute_force(spark, docs):
    r = random.Random(3)
    texts = TEXTS + [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(60)]
    d = docs(*[(i, t) for i, t in enumerate(texts)])
    for x in qr.judge(d).collect():
        m = x["measures"]
        want = brute(texts[x["doc_id"]])
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == want, texts[x["doc_id"]]
        assert x["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (x["kept"] and x["base_failed"])


def test_rules_edges(spark, docs, clashing):
    assert qr.judge(docs()).count() == 0
    good = "the quick one and the other of them are in it for the long day " * 1 + "with some more words that do not repeat at all"
    out = qr.judge(clashing((1, good), (1, good), (None, None)))
    rows = {(x["doc_id"], x["kept"]) for x in out.collect()}
    assert rows == {(1, True), (None, False)} and "score" in out.columns
    assert qr.judge(docs((1, ("word%d " * 30000) % tuple(range(30000))))).first()["measures"]["n_words"] == 30000


def test_rules_are_one_projection_without_functions(spark, docs):
    plan = qr.judge(docs((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def waterfill(sizes, weights, share=1.5):
    total, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        left = total - sum(target.values())
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_the_reshared_ones(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 5, 100, 3000]) for i in range(9)} | {None: 50}
    d = spark.createDataFrame(list(sizes.items()), "source string, size long")
    names = sorted(s for s in sizes if s is not None) + [None]
    want = waterfill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for x in mixing.source_targets(d).collect():
        assert math.isclose(x["target"], want[x["source"]], rel_tol=1e-9, abs_tol=1e-9)


def test_mix_takes_what_the_plan_says(spark, docs, clashing):
    r = random.Random(1)
    rows = [(i, None if i % 50 == 0 else "w " * r.randint(0, 40), "en", r.choice(["a", "b", "c", "ü", None])) for i in range(600)]
    d = docs(*rows)
    sized = d.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.source_plan(sized)
    out = mixing.copies(sized, plan).collect()
    taken, target, copies = defaultdict(int), {}, {}
    for x in out:
        assert x["copies"]["n"] <= 2
        taken[x["source"]] += x["size"] * x["copies"]["n"]
        target[x["source"]] = x["copies"]["target"]
        copies[x["doc_id"]] = x["copies"]["n"]
    for s in target:
        assert abs(taken[s] - target[s]) <= max(60, 0.05 * target[s])
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    got = {x["doc_id"]: x["count"] for x in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in copies.items() if n}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))


def test_mix_edges(spark, docs, clashing):
    assert mixing.mix(docs()).count() == 0
    assert mixing.mix(docs((1, None), (2, ""))).count() == 0
    c = clashing((1, "a b c"), (1, "a b c"), (None, "x y"))
    assert set(mixing.mix(c).columns) == set(c.columns)

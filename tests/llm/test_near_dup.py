import random

import numpy as np
import pytest

from tallyloom.llm import near_dup as nd
from tallyloom.llm.shingles import overlap, shingle_sets


def shingles(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    label = {}
    for i, (k, _) in enumerate(rows):
        label[root(i)] = min(label.get(root(i), k), k)
    return {k: (len(sets[i]), label[root(i)]) for i, (k, _) in enumerate(rows)}


def mutated(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    rows = [None, "", "   ", "One", "one", "ONE two", "one  two", "a b c d", "a b c d e", "a b c d e f", "a b c d e f g"]
    for _ in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([6, 12, 40, 150]))]
        for _ in range(r.randint(1, 8)):
            rows.append(mutated(r, base, r.randint(0, max(1, len(base) // 30))))
    rows += [rows[-1]] * 5 + [rows[-3].upper()] * 3
    r.shuffle(rows)
    ids = r.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def test_shingle_sets_match_brute_force():
    r = random.Random(0)
    texts = [t for _, t in corpus(9)] + [" ".join(r.choice("abcAB") for _ in range(200)), "é ß Ü\x0bx\x0cy z\r\nw", "w " * 300000]
    sets = shingle_sets(texts)
    for t, s in zip(texts, sets):
        assert len(s) == len(shingles(t)), t
    for i in range(0, len(texts) - 2, 3):
        assert overlap(sets[i], sets[i + 1]) == len(shingles(texts[i]) & shingles(texts[i + 1]))


@pytest.mark.parametrize("seed", range(2))
def test_components_match_brute_force(spark, docs, seed):
    rows = corpus(seed)
    want = brute(rows)
    for x in nd.find(docs(*rows)).collect():
        assert (x["n_shingles"], x["component_id"]) == want[x["doc_id"]]
        assert x["kept"] == (x["doc_id"] == x["component_id"])


def test_links_that_the_first_hub_misses_are_found(spark, docs):
    # A large group whose members are linked with a centre, and pairs linked only with each other.
    r = random.Random(5)
    base = [f"c{i}" for i in range(120)]
    rows = [(k, mutated(r, base, 2)) for k in range(40)]
    for k in range(10):
        far = mutated(r, base, 5).split()
        rows += [(100 + 2 * k, " ".join(far)), (101 + 2 * k, mutated(r, far, 1))]
    want = brute(rows)
    got = {x["doc_id"]: x["component_id"] for x in nd.find(docs(*rows)).collect()}
    assert got == {k: v[1] for k, v in want.items()}


def test_bins_agree_as_similar_as_sets():
    r = np.random.default_rng(1)
    for n in (8, 60, 2000):
        same, bins = 0, 0
        for _ in range(30):
            x = r.integers(0, 2**63, n + 2 * max(1, n // 7), dtype=np.uint64)
            cut = max(1, n // 7)
            a, b = np.unique(x[: n + cut]), np.unique(np.concatenate((x[:n], x[n + cut :])))
            same += (nd.bin_minima(a) == nd.bin_minima(b)).sum()
            bins += nd.BINS
        j = n / (n + 2 * max(1, n // 7))
        assert abs(same / bins - j) < 0.06


def test_no_similar_pair_is_ruled_out_by_a_sketch(spark, docs):
    # Texts of three shingles, and each with one word more: similarity exactly 0.75.
    rows = []
    for k in range(3000):
        words = [f"p{k}x{i}" for i in range(8)]
        rows += [(2 * k, " ".join(words[:7])), (2 * k + 1, " ".join(words))]
    got = nd.find(docs(*rows)).collect()
    assert [x["doc_id"] for x in got if x["component_id"] != x["doc_id"] // 2 * 2] == []


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(3)
    for n, more in ((3, 1), (6, 2), (75, 25), (3000, 1000), (20000, 3000)):
        x = r.integers(0, 2**63, n + more, dtype=np.uint64)
        bits = np.bitwise_count((nd.sketch(np.sort(x[:n])) ^ nd.sketch(np.sort(x))).view(np.uint64)).sum()
        assert bits <= more and bits % 2 == more % 2


def test_edges(spark, docs, clashing):
    assert nd.find(docs()).count() == 0 and nd.find(docs((1, None))).first()["component_id"] == 1
    c = clashing((2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None))
    rows = sorted(((x["doc_id"] or 0, x["component_id"], x["kept"]) for x in nd.find(c).collect()), key=str)
    assert rows == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = nd.keep_one(c)
    assert kept.columns == c.columns and sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 3]


def test_rows_repeated_many_times_stand_for_one(spark, docs):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(7, a)] * 400 + [(9, a + " more")] * 400 + [(8, "x y z")] * 3
    got = nd.find(docs(*rows))
    assert got.groupBy("doc_id", "component_id").count().orderBy("doc_id").collect() == [(7, 7, 400), (8, 8, 3), (9, 7, 400)]
    assert sorted(x["doc_id"] for x in nd.keep_one(docs(*rows)).collect()) == [7, 8]


def test_string_ids_and_several_texts_under_one_id(spark):
    a = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([("b", a), ("a", a + " more"), ("c", "p q r s t u"), ("a", "p q r s t u"), ("a", "unlike all else here now")], "doc_id string, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in nd.find(d).collect())
    assert got == [("a", 1, "a"), ("a", 2, "a"), ("a", 57, "a"), ("b", 56, "a"), ("c", 2, "a")]
    kept = nd.keep_one(d)
    assert kept.columns == ["doc_id", "text"] and sorted(x["text"][:3] for x in kept.collect()) == ["p q", "unl", "w0 "]

"""Phrases by pair naming against plain counting."""

import collections
import random
import re

import pytest

from tallyloom.llm import collocations as co

CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plainly(rows, longest=3, least=10, covered=50, top=2000):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang or "und", tuple(w[i : i + k])] += 1
    cand = {p: n for p, n in count.items() if len(p[1]) > 1 and n >= least}
    drop = set()
    for (lang, w), n in cand.items():
        for k in range(2, len(w)):
            drop |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * n >= covered * cand[lang, w[i : i + k]]}
    by = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in drop:
            cuts = [(1_000_000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by[lang].append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, v in by.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1))


def found(df, **kw):
    return sorted(tuple(r) for r in co.top_phrases(co.phrases(df, **kw)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def drawn(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "c", "New", "york", "É", "é", "ab", "\x1f", " ", " x"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b", " ;", " "]
    return [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))) if rng.random() < 0.95 else None, rng.choice(["en", "de", None, "und"])) for i in range(n)]


@pytest.fixture
def rows():
    return drawn(1, 300) + [(i, "of the One same passage of the one", "en") for i in range(40)] + [(1, "long " * 20_000 + ".".join(["x y z"] * 5000), "fr"), (2, "", "xx"), (None, None, None)]


def test_phrases_against_plain_counting(spark, docs, rows):
    want = plainly(rows)
    assert want and found(docs(*[(*r, "s") for r in rows]).repartition(5)) == want
    # Chunks of any size, and longer phrases.
    assert found(docs(*[(*r, "s") for r in rows]).repartition(7), chunk_bytes=500) == want
    assert found(docs(*[(*r, "s") for r in rows[:340]]), max_words=5, least=3, covered=80) == plainly(rows[:340], 5, 3, 80)
    assert found(docs(*[(*r, "s") for r in rows[:340]]), max_words=2) == plainly(rows[:340], 2)


def test_empty_tables_and_clashing_columns(spark, docs, clashing):
    assert found(docs()) == [] == found(docs((1, None), (2, ""), (3, "a b")))
    assert found(clashing(*[(i, "p q r") for i in range(10)])) == plainly([(i, "p q r", "en") for i in range(10)])


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 123_456_789_012, 987_654_321_987, 223_456_789_013
    df = spark.createDataFrame([(a, left, right), (10, 10, 10), (3, 7, 3)], "a long, l long, r long")
    got = [r[0] for r in df.select(co._score(df.a, df.l, df.r)).collect()]
    assert got == [1_000_000 * a * a // (left * right), 1_000_000, 1_000_000 * 9 // 21]


def test_a_hot_language_is_ranked_in_shares(spark):
    from pyspark.sql import functions as F

    n = 3000
    many = spark.range(n).select(F.lit("en").alias("lang"), F.format_string("p %05d", "id").alias("phrase"), F.lit(2).alias("words"), (F.col("id") % 7 + 10).alias("a"), F.lit(20).alias("l"), F.lit(20).alias("r"), F.lit(99).alias("n"), (F.col("id") % 5).alias("score"), F.lit(False).alias("inside"))
    want = sorted(range(n), key=lambda i: (-(i % 5), -(i % 7), i))[:50]
    assert [(r.rank, r.phrase) for r in co.top_phrases(many, 50).orderBy("rank").collect()] == [(k, f"p {i:05d}") for k, i in enumerate(want, 1)]

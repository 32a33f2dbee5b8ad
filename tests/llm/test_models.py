import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fm_quality as fm, html_text as ht, language_id as lid, toxicity as tx
from tallyloom.llm.common import fold

SF = "/root/testdata/sf0.01"


def test_fm_identity_equals_all_pairs():
    r = np.random.default_rng(0)
    m = fm.Machine(0.3, r.normal(size=fm.SIZE), r.normal(size=(fm.SIZE, fm.RANK)))
    i, x = fm.features("The quick & the dead | went ON 3 times.\nAnd back.", 40)
    i, x = i[:14], x[:14]
    pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a, b in itertools.combinations(range(len(i)), 2))
    assert math.isclose(m.margin(i, x), 0.3 + m.w[i] @ x + pairs, rel_tol=1e-9)


def test_fm_fit_learns_an_interaction():
    r = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(400):
        a, b = r.integers(0, 2, 2)
        rows.append((np.array([10 + a, 20 + b]), np.ones(2)))
        y.append(float(a != b))
    m = fm.fit(rows, np.array(y), np.ones(len(y)), epochs=60)
    assert np.mean([(m.margin(*x) > 0) == t for x, t in zip(rows, y)]) > 0.95


def test_quality_edges(spark, docs, clashing):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = fm.train(docs(), empty, F.lit(True))
    out = fm.score(clashing((1, None), (1, None), (2, ""), (None, "a " * 50000)), m, out="p").collect()
    assert len(out) == 4 and all(0 <= x["p"] <= 1 for x in out)
    assert fm.score(docs(), m).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert 0 <= fm.train(docs((1, "a")), one, F.lit(True)).score("x", None) <= 1


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test data")
def test_quality_held_out(spark):
    got = fm.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got[got.quality == 1].predicted == 1).mean() > 0.95 and (got[got.quality == 0].predicted == 0).mean() > 0.9
    assert not spark.read.parquet(f"{SF}/labels.parquet").where(fold(4) != 2).where("doc_id IS NULL").count()


def test_viterbi_equals_all_paths():
    r = random.Random(0)
    lengths = [5, 0, 3, 6, 1]
    scores = np.array([[r.uniform(-5, 5) for _ in range(3)] for _ in range(sum(lengths))], np.float32)
    path = lid.viterbi(scores, np.array(lengths), 2.0)
    at = 0
    for n in lengths:
        s, p = scores[at : at + n].astype(float), path[at : at + n].tolist()
        value = lambda q: sum(s[t, k] for t, k in enumerate(q)) - 2.0 * sum(a != b for a, b in zip(q, q[1:]))
        best = max((value(q) for q in itertools.product(range(3), repeat=n)), default=0)
        assert math.isclose(value(p), best, abs_tol=1e-4)
        at += n


def test_language_spans_and_scripts(spark, docs, clashing):
    r = random.Random(4)
    word = {"en": ["the", "and", "with", "house", "water", "thing"], "fr": ["les", "dans", "maison", "eau", "chose", "avec"], "ru": ["дом", "вода", "это", "вещь", "как"]}
    rows = [(i, " ".join(r.choice(word[k]) for _ in range(40)), k, "s") for i, k in enumerate(["en", "fr", "ru"] * 20)]
    m = lid.train(docs(*rows), F.lit(True))
    mixed = " ".join(["the house and water"] * 5 + ["les maison dans avec"] * 5)
    got = {x["doc_id"]: x["language"] for x in lid.label(clashing((1, mixed), (2, None), (3, "12 34 !"), (4, "дом вода"), (5, ""), (None, "les eau"), (6, "the " * 100000)), m, out="language").collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "fr"] and got[1]["spans"][0]["words"] == 20
    assert got[2]["lang"] == got[3]["lang"] == got[5]["lang"] == "und" and got[4]["lang"] == "ru" and got[None]["lang"] == "fr" and got[6]["lang"] == "en"
    assert lid.label(docs(), m).count() == 0
    none = lid.train(docs((1, None)), F.lit(True))
    assert lid.label(docs((1, "abc")), none).first()["language"]["lang"] == "und"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test data")
def test_language_held_out(spark):
    got = lid.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_crf_decodes_the_best_labelling():
    m = ht.trained()
    for bs, _ in ht.labelled_pages(25, 5):
        bs = bs[:9]
        s = m.scores(bs)
        value = lambda y: m.ends[0][y[0]] + m.ends[1][y[-1]] + sum(s[t, k] for t, k in enumerate(y)) + sum(m.step[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(bs)), key=value)
        assert math.isclose(value(m.decode(bs)), value(best), abs_tol=1e-9)


def test_crf_held_out_pages():
    m, right, n = ht.trained(), 0, 0
    for bs, y in ht.labelled_pages(150, 77):
        right += sum(a == b for a, b in zip(m.decode(bs), y))
        n += len(y)
    assert right / n > 0.98


def test_html_cases(spark, clashing):
    m = ht.trained()
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>"
        "<article><h1>A title &amp; more</h1><p>First <b>bold</b>\n\t text, with&nbsp;space.<br>Next line.<p>Second paragraph of it, unclosed.<div class=ad>Buy this now, it is great.</div>"
        "<p>Third one, after the advert.</p></article><section id=comments><h3>Comments</h3><p>Nice post, thank you for it.</p></section><footer>&copy; 2020 Site</footer>"
    )
    assert ht.main_text(page, m) == "A title & more First bold text, with space. Next line. Second paragraph of it, unclosed. Third one, after the advert."
    assert ht.main_text(None, m) == ht.main_text("", m) == ""
    long = "<article>" + "<p>Some words of a text, again.</p>" * 20000 + "</article>"
    assert len(ht.main_text(long, m)) == 20000 * len("Some words of a text, again. ") - 1
    df = spark.createDataFrame([(1, page, "x"), (1, page, "x"), (2, None, "x")], "page_id long, html string, n_chars string")
    out = ht.extract(df).collect()
    assert [x["extracted"]["n_chars"] for x in out if x["page_id"] == 2] == [0] and len(out) == 3


def test_toxicity_chain(spark, docs, clashing):
    r = random.Random(2)
    bad = ["idiot", "moron", "scum", "pathetic", "worthless", "blorkiest", "blorkish", "blorkly"]
    rows, labels = [], []
    for i in range(400):
        w = [f"w{r.randrange(300)}" for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    d, l = docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = tx.train(d, l)
    got = {x["doc_id"]: x["toxicity"] for x in tx.score(d, m).collect()}
    assert np.mean([(got[i]["toxic"] >= 0.5) == bool(t) for i, _, t in labels]) > 0.98
    assert len(m.weights) == 3 and len(m.weights[2]) == len(m.number) + 3
    new = {x["doc_id"]: x["toxicity"]["toxic"] for x in tx.score(clashing((1, "w1 w2 blorkend w3 blorkish"), (2, "w1 w2 w3"), (3, None), (4, "")), m, out="toxicity").collect()}
    assert new[1] > 0.5 > max(new[2], new[3], new[4])
    assert tx.reject(docs(), m).count() == 0
    c = clashing((1, "w1 idiot scum"), (2, "w1"), (2, "w1"), (None, None))
    kept = tx.reject(c, m)
    assert kept.columns == c.columns and kept.count() == 3
    assert tx.reject(docs((1, "idiot")), tx.train(docs(), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 1


def test_html_hostile_pages_take_linear_time():
    import time

    m = ht.trained()
    for part in ('<a "', "<div>x", "<svg>", "</p><div>x", "<p title='", '<b c=">" ', "<!", "<template>", "<div class=content>x", '<a b="c', "&amp;<"):
        start = time.perf_counter()
        ht.main_text(part * (300_000 // len(part)), m)
        assert time.perf_counter() - start < 15, part


def test_html_keeps_fallbacks_and_formulas():
    m = ht.trained()
    page = "<article><h1>A title of it</h1><p>The value <math>x + y</math> is here, as said before.</p><noscript>A picture of the river, as it was.</noscript><object>A drawing of the bridge, as it was.</object><svg><text>Map</text></svg><p title=it's>Don't drop this, please.</p><p data-x='a>b'>Nor this one, of course.</p></article>"
    assert ht.main_text(page, m) == "A title of it The value x + y is here, as said before. A picture of the river, as it was. A drawing of the bridge, as it was. Map Don't drop this, please. Nor this one, of course."
    assert ht.blocks("<article><p>Open to the end, of <a href='x")[0].text == "Open to the end, of <a href='x"


def test_out_of_fold_probabilities_have_not_seen_their_labels():
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 200).astype(float)
    hits = [[k] for k in range(200)]  # a text's only entry tells its label to whoever has seen it
    fold = np.arange(200) % tx.FOLDS
    got = tx.out_of_fold([hits] * tx.FOLDS, np.zeros((200, 0)), y, np.ones(200), fold, 200)
    w, b = tx._fit(hits, np.zeros((200, 0)), y, np.ones(200), 200)
    seen = tx._probability(hits, np.zeros((200, 0)), w, b, 200)
    assert ((seen > 0.5) == (y == 1)).all()
    assert all(np.ptp(got[fold == f]) < 1e-9 for f in range(tx.FOLDS))


def test_toxicity_kinds_part_the_toxic_texts():
    hits = [[0, 1], [0, 1, 2], [1, 2], [5, 6], [5, 6, 7], [6, 7], [3]]
    a, b = tx.kinds(hits, np.array([1.0] * 6 + [0.0]), 8)
    assert sorted((a.tolist(), b.tolist())) == [[0.0] * 3 + [1.0] * 3 + [0.0], [1.0] * 3 + [0.0] * 4]


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test data")
def test_toxicity_held_out_and_by_hand(spark):
    big = SF.replace("0.01", "0.1")  # sf0.01 has too few toxic rows to learn from
    d, l = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{big}/labels.parquet")
    m = tx.train(d, l.where(fold(3) != 0))
    got = tx.score(d.join(l, "doc_id"), m).withColumn("held", fold(3) == 0).collect()
    held = [(x["toxic"], x["toxicity"]["toxic"] >= 0.5) for x in got if x["held"]]
    assert np.mean([p for t, p in held if t == 1]) > 0.9 and np.mean([p for t, p in held if t == 0]) < 0.03
    for x in got[:60]:  # the chain by hand
        have = [m.number[e] for e in tx.entries(x["text"]) if e in m.number]
        ps = []
        for w, b in zip(m.weights, m.bias):
            z = b + sum(w[k] for k in have) + math.log1p(len(have)) * w[len(m.number)] + sum(p * q for p, q in zip(ps, w[len(m.number) + 1 :]))
            ps.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert all(math.isclose(p, x["toxicity"][c], abs_tol=1e-9) for p, c in zip(ps, tx.CHAIN))


def test_every_language_is_learned_and_memory_does_not_grow_with_words_times_languages(docs, monkeypatch):
    import tracemalloc

    n = 3000
    rows = [(i, f"zq{i}x zq{i}y zq{i}z", f"l{i:04d}", "s") for i in range(n)]
    m = lid.train(docs(*rows), F.lit(True))
    assert len(m.names) == n
    monkeypatch.setattr(lid, "CELLS", 1 << 18)
    text = " ".join(["zq7x zq7y"] * 10_000 + ["zq2999x zq2999z"] * 5_000)
    tracemalloc.start()
    got = lid._labelled([text, "zq5x zq5y zq5z", None], m, lid.SWITCH, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Scores of all words would take 360 MB.
    assert peak < 120e6
    assert got[0][2] == [(0, 20_000, "l0007"), (20_000, 10_000, "l2999")] and got[1][0] == "l0005" and got[2][0] == "und"


def test_blocks_of_scores_do_not_change_paths(monkeypatch):
    rng = random.Random(6)
    names = ["a", "b", "c"]
    words = [f"w{k}" for k in range(30)]
    log_p = np.random.default_rng(1).normal(-9, 2, (lid.BUCKETS, 3)).astype(np.float32)
    m = lid.Languages(names, log_p, np.ones((len(lid._NAMES), 3), bool))
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 300]))) for _ in range(40)]
    want = lid._labelled(texts, m, 3.0, True)
    for cells in (1, 7, 100, 5000):
        monkeypatch.setattr(lid, "CELLS", cells)
        assert lid._labelled(texts, m, 3.0, True) == want


def test_repeated_rows_are_learned_from_once(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    d = docs(*[(1, "good text here")] * 50, *[(2, "bad text here")] * 50)
    one = docs((1, "good text here"), (2, "bad text here"))
    a, b = fm.train(d, labels, F.lit(True)), fm.train(one, labels, F.lit(True))
    assert a.score("good text", 9) == pytest.approx(b.score("good text", 9), abs=0.05)

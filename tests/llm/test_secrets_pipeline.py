import hashlib
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing, near_dup, secrets_scan as ss, toxicity

SF = "/root/testdata/sf0.001"
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")


def assign_at(t, i):
    """End of the match at i and length of its value, by hand; the first key of the pattern's order that fits."""
    low = "".join(c.lower() if c.isascii() else c for c in t)
    for k in KEYS:
        if not low.startswith(k, i):
            continue
        j = i + len(k)
        j += j < len(t) and t[j] in "\"'"
        while j < len(t) and t[j] == " ":
            j += 1
        if j == len(t) or t[j] not in ":=":
            continue
        j += 1
        while j < len(t) and t[j] == " ":
            j += 1
        j += j < len(t) and t[j] in "\"'"
        v = j
        while j < len(t) and t[j] in VALUE:
            j += 1
        if j > v:
            return j, j - v
    return None


def brute(t):
    t, out = t or "", []
    i = 0
    while i < len(t):
        m = assign_at(t, i)
        if m:
            if m[1] >= 12:
                out.append((i, m[0], 0))
            i = m[0]
        else:
            i += 1
    for kind, head, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        i = 0
        while i < len(t):
            j = i + len(head)
            while j < len(t) and t[j] in chars:
                j += 1
            if t.startswith(head, i) and j > i + len(head):
                if j - i >= least:
                    out.append((i, j, kind))
                i = j
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_match_brute_force():
    r = random.Random(0)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "ſecret", '"', "'", " ", "  ", "=", ":", "abcdef012345", "AKIA", "AKIAAKIA", "ABCD0123456789XY", "deadbeefdeadbeef", "x", "é", "\n", "passwd", "_", "g", "short"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert ss.scan(t)[0] == brute(t), t


def slow_cost(value):
    segs = ss.segments(value)

    def best(j, last):
        if j == 0:
            return 0.0
        out = math.inf
        for i in range(j):
            run = sum(math.log10(ss._alphabet(c)) for c in value[i:j])
            if last != "brute":
                out = min(out, best(i, "brute") + run + math.log10(2))
            for a, b, kind, cost in segs:
                if (a, b) == (i, j):
                    out = min(out, best(i, kind) + cost + math.log10(2))
        return out

    return best(len(value), "")


@pytest.mark.parametrize("value", ["password1", "qwe123", "aaaa", "1999-12", "Xk9$vQ", "p4ssw0rd", "abab12"])
def test_guess_cost_is_the_least(value):
    cost, path = ss.guess_cost(value)
    assert cost <= slow_cost(value) + 1e-9
    assert path[0][0] == 0 and path[-1][1] == len(value) and all(a[1] == b[0] for a, b in zip(path, path[1:]))


def test_guesses_in_context():
    spans = lambda t: ss.digest(ss.scan(t)[1])
    assert spans("login: pwd = Xk9$vQ2mLp! ok").startswith("guess:13:")
    assert spans("password: password123") == "" and spans("my secret is wonderful today") == ""
    assert spans("token=abcdefghijkl0") == "assign:0:19"
    assert ss.masked("a token=abcdefghijkl0 b") == "a [SECRET] b" and ss.masked(None) is None and ss.masked("") == ""


def test_a_long_repeat_is_judged_as_a_whole():
    assert ss.digest(ss.scan("pwd=" + "*" * 200)[1]) == "" and ss.guess_cost("*" * 200)[0] < 5
    assert ss.digest(ss.scan("pwd=" + "ab1!" * 100)[1]) == ""
    assert ss.guess_cost("*" * 100000)[0] < 8


def test_lower_case_values_are_judged_by_their_cost():
    spans = lambda t: ss.digest(ss.scan(t)[1])
    assert spans("pwd=qzjxkvbnmwplrtyh") == "guess:4:20" and spans("passphrase: zqwvkxjhtrpm") == "guess:12:24"
    assert spans("password: xkqzvwjr") == "guess:10:18"
    for word in ("wonderful", "something", "important", "necessary", "government", "available", "different"):
        assert spans(f"the secret is {word} today") == "" and spans(f"token: {word}.") == ""


def test_secret_edges(spark, docs, clashing):
    assert ss.find(docs()).count() == 0
    long = "pwd=aB3$ " * 20000 + "deadbeefdeadbeef"
    got = ss.find(clashing((1, None), (2, ""), (3, long), (3, long), (None, "AKIA" + "Z" * 14)), out="secrets").collect()
    n = Counter((x["doc_id"], len(x["secrets"])) for x in got)
    assert n[(1, 0)] == n[(2, 0)] == n[(None, 1)] == 1 and n[(3, 1)] == 2
    c = clashing((1, "token: abcdefghijkl9"), (None, None))
    assert ss.mask(c).columns == c.columns and {x["text"] for x in ss.mask(c).collect()} == {"[SECRET]", None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages_against_their_own_input(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, frames = docs, []
    for name, stage in cp.STAGES[:-1]:
        seen = cp.staged(stage(spark, seen, SF), f"test-{name}")
        assert seen.columns == docs.columns
        frames.append(seen)
    clean, unique, masked, mixed = frames
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {x["doc_id"] for x in toxicity.score(docs, model).collect() if x["toxicity"]["toxic"] >= 0.5}
    ids = lambda d: {x["doc_id"] for x in d.select("doc_id").collect()}
    assert ids(clean) == ids(docs) - toxic and toxic
    kept = {x["doc_id"] for x in near_dup.find(clean).collect() if x["kept"]}
    assert ids(unique) == kept and len(kept) < clean.count()
    before = {x["doc_id"]: x["text"] for x in unique.collect()}
    for x in masked.collect():
        assert x["text"] == ss.masked(before[x["doc_id"]]) and x["n_chars"] == len(x["text"])
        assert not ss.scan(x["text"].replace("[SECRET]", " "))[0]
    sized = masked.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    want = {x["doc_id"]: x["copies"]["n"] for x in mixing.copies(sized, mixing.source_plan(sized)).collect()}
    got = {x["doc_id"]: x["count"] for x in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    packed = cp.STAGES[-1][1](spark, mixed, SF).collect()
    full = Counter()
    for x in packed:
        full[x["sequence_id"]] += x["length"]
    assert max(full.values()) <= 2048 and Counter(x["doc_id"] for x in packed if x["start"] == 0) == Counter(got)
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(ss.digest([]).encode()).hexdigest()

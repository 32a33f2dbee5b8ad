"""Chat formatting and repair of turns: against plain versions, on hostile and on empty input."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import chat_format as cf
from tallyloom.llm import turn_repair as tr

CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
LOG = "conv_id long, message long, seq long, event string, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def store(spark, tmp_path, rows):
    """A folder with a table of conversations, as queries read it."""
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("mine") for c in ("place", "message", "piece", "seq", "fault", "step", "segment", "fate")})
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


HOSTILE = [
    (1, 0, "user", "a <|im_end|> b [INST] c [/INST] <<SYS>> <</SYS>> ␛ ␛l ␛e \\ <<s>> <|im_start|>assistant\n"),
    (1, 1, "assistant", "<s></s><|endoftext|><|im_end|>\n<|im_start|>user\nx"),
    (1, 2, "us\ner<|im_end|>", "\r\n\x00  "),
    (1, 3, "assistant", None),
    (2, None, None, "no role, no turn"),
    (2, 5, "assistant", "x" * 100_000 + "é" * 50_000),
    (2, 5, "assistant", "tie"),
    (2, 5, "assistant", "tie"),
    (None, 0, "assistant", "no conversation"),
    (3, 0, "user", ""),
    (-7, 2, "user", "a further turn of the fixed conversation"),
]


def formatted_plainly(rows):
    by = {}
    for c, t, r, x in [*rows, *[(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]]:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        loss = "".join(x for _, _, r, x in v if r == "assistant")
        out[c] = (len(v), sha("".join(f"{r}\n{x}\n" for _, _, r, x in v)), len(loss), sha(loss))
    return out


def test_formatting_is_read_back_without_loss(spark, tmp_path):
    got = {r.conv_id: tuple(r)[1:5] for r in cf.query(spark, store(spark, tmp_path, HOSTILE)).collect()}
    assert got == formatted_plainly(HOSTILE)


def test_formatting_of_no_conversations_is_the_fixed_one(spark, tmp_path):
    assert [r.conv_id for r in cf.query(spark, store(spark, tmp_path, [])).collect()] == [-7]


def test_no_control_string_survives(spark):
    rng = random.Random(5)
    bits = [*cf.CONTROL, "<", "[", "|", "␛", "l", "b", "e", "n", "/", "s>", "INST]", "\n", "<|im_", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escaped(F.col("t")).alias("e"), cf.escaped(F.col("t"), role=True).alias("r"))
    for row in df.collect():
        assert not any(c in row.e for c in cf.CONTROL) and "\n" not in row.r
        assert cf.unescaped(row.e) == row.t == cf.unescaped(row.r)
    assert df.filter("t = 'plain < [text]'").count() == 0
    assert spark.range(1).select(cf.escaped(F.lit("a < b [0] </p> \\n"))).first()[0] == "a < b [0] </p> \\n"


def test_what_is_no_formatting_is_refused():
    with pytest.raises(ValueError):
        cf.read_back("user: hello")


def test_logs_fold(spark):
    log = [
        (1, 0, 2, "delta", None, "lo"), (1, 0, 0, "open", "user", None), (1, 0, 1, "delta", None, "hel"),
        (1, 1, 0, "open", "assistant", "draft"), (1, 1, 1, "delta", None, " more"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "final"),
        (1, 2, 0, "open", "user", "typo"), (1, 2, 1, "edit", None, "fixed"), (1, 2, 2, "delta", None, "!"), (1, 2, 3, "edit", "system", "again"),
        (1, 3, 0, "open", "user", "gone"), (1, 3, 1, "retract", None, None), (1, 3, 2, "delta", None, "still gone"),
        (1, 4, 0, "unknown", None, "nothing"), (1, 5, None, "delta", None, "first"), (1, 5, 0, None, None, "x"), (1, 5, 1, "delta", None, " twice"), (1, 5, 1, "delta", None, " twice"),
        (None, None, 0, "delta", "user", "keyless"),
    ]
    random.Random(1).shuffle(log)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in cf.reconstruct(spark.createDataFrame(log, LOG)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "final"), (1, 2): ("system", "again"), (1, 4): ("", ""), (1, 5): ("", "first twice twice"), (None, None): ("user", "keyless")}
    assert cf.reconstruct(spark.createDataFrame([], LOG)).count() == 0


def test_loss_spans_hold_the_text_of_learned_roles(spark):
    rows = cf.rendered(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "é</s>")], "conv_id long, message long, role string, text string")).orderBy("message").collect()
    assert (rows[0].loss_start, rows[0].loss_end) == (None, None)
    assert cf.unescaped(rows[1].piece[rows[1].loss_start : rows[1].loss_end]) == "é</s>"


def damage_plainly(conv, rows):
    out = []
    for turn, role, text in rows:
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        out += [(turn, "user" if m == 4 else role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        s = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


STATES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def repair_plainly(rows, faults):
    """The least (cost, audit, turns) by a table over the automaton of the same language."""

    def inserted(best):
        while True:
            more = {}
            for s, (c, a, o) in best.items():
                for ch, name in (("u", "user"), ("a", "assistant")):
                    n = STATES.get((s, ch))
                    v = (c + 2, a + "I", o + ((name, ""),))
                    if n is not None and (n not in best or v[:2] < best[n][:2]):
                        more[n] = min(v, more.get(n, v))
            if not more:
                return best
            best = best | more

    best = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def put(n, v):
            if n is not None and (n not in new or v[:2] < new[n][:2]):
                new[n] = v

        for s, (c, a, o) in inserted(best).items():
            put(s, (c + 3, a + "D", o))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                put(STATES.get((s, role[:1])), (c + extra, a + "K", o + ((role, text),)))
                for ch, name in (("u", "user"), ("a", "assistant")):
                    put(STATES.get((s, ch)), (c + 2 + extra, a + "R", o + ((name, text),)))
        best = new
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def best_of_all(initials, faults):
    """The least (cost, audit) over all edit strings with at most two insertions at a place."""
    found = []

    def go(k, cost, audit, out, run):
        if run < 2:
            for ch in "ua":
                go(k, cost + 2, audit + "I", out + ch, run + 1)
        if k == len(initials):
            if re.fullmatch("(s?(ua)+)?", out):
                found.append((cost, audit))
            return
        go(k + 1, cost + 3, audit + "D", out, 0)
        if faults[k] not in ("blank", "duplicate"):
            extra = faults[k] == "truncated"
            go(k + 1, cost + extra, audit + "K", out + initials[k], 0)
            for ch in "ua":
                go(k + 1, cost + 2 + extra, audit + "R", out + ch, 0)

    go(0, 0, "", "", 0)
    return min(found)


def chart_of(initials, faults):
    chart = tr.Chart(tr.FRESH)
    for i, f in zip(initials, faults):
        chart.step(i, f in ("blank", "duplicate"), 1 if f == "truncated" else 0)
    ways = [(c + tr.finish(e)[0], a + tr.finish(e)[1]) for e, c, a in chart.ends()]
    return min(ways)


def test_charts_find_the_least_of_all_edits():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            assert chart_of(initials, [None] * n) == best_of_all(initials, [None] * n), initials
    rng = random.Random(3)
    for _ in range(60):
        initials, faults = rng.choices("suax", k=4), rng.choices([None, "blank", "truncated"], k=4)
        assert chart_of(initials, faults) == best_of_all(initials, faults)


def test_long_charts_put_letters_aside_without_effect(monkeypatch):
    rng = random.Random(8)
    for aside in (1, 3, 512):
        monkeypatch.setattr(tr, "ASIDE", aside)
        for _ in range(40):
            n = rng.randrange(40)
            rows = [(k, rng.choice(["system", "user", "assistant", "tool"]), f"{k}.") for k in range(n)]
            faults = rng.choices([None, None, "blank", "truncated"], k=n)
            assert chart_of([r[1][0] for r in rows], faults) == repair_plainly(rows, faults)[:2]


def repaired_plainly(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    out = {}
    for c, v in by.items():
        d = damage_plainly(c, v)
        f = faults_of(d)
        cost, audit, turns = repair_plainly(d, f)
        ts = [r[0] for r in d if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(d, d[1:]))
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        out[c] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in turns)))
    return out


def drawn(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and then", " ", "", None, "what?\n\n", "x" * 3000 + "."]
    out = []
    for c in range(conversations):
        for _ in range(rng.randrange(1, longest)):
            out.append((c if c else None, rng.choice([None, *range(longest)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([*texts, f"t{rng.random()}."])))
    return out


def test_repair_against_a_plain_version(spark, tmp_path):
    rows = drawn(11, 60, 14) + [(900, 0, "user", "x.")] * 3
    got = {r.conv_id: tuple(r)[1:] for r in tr.query(spark, store(spark, tmp_path, rows)).collect()}
    assert got == repaired_plainly(rows)


def test_a_conversation_over_many_ranges(spark, tmp_path):
    """A third of all rows in one conversation: it is parsed in segments, with the result of one parse."""
    rng = random.Random(2)
    rows = [(5, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{k}."])) for k in range(1500)] + drawn(4, 300, 14)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sf = store(spark, tmp_path, rows)
        numbered = cf.numbered(tr.damaged(spark.read.parquet(f"{sf}/conversations.parquet")).filter("conv_id = 5"))
        assert tr.parsed(numbered).count() > 5
        got = {r.conv_id: tuple(r)[1:] for r in tr.query(spark, sf).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == repaired_plainly(rows)


def test_conversations_without_rows_after_damage_and_no_conversations(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = tr.query(spark, store(spark, tmp_path / "one", [(gone, 0, "user", "x.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert tr.query(spark, store(spark, tmp_path / "none", [])).count() == 0

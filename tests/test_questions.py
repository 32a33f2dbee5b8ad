"""Question text functions on hand-made cases, and the tags against a row-by-row version with Python's patterns."""

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import lexicon as lx, text as tx
from tallyloom.plans import questions as qs


def one(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(cols)]).orderBy("i").collect()]


def test_answers(spark):
    t = F.col("t")
    got = one(spark, ["A chair is left of B", "The cat. A small dog sits. ``C``", "``B`` because", "`d` `D`", "{A}", "no", "", None, "answer is b"], tx.answer(t), tx.answer_rule(t))
    assert got == [("B", 3), ("C", 0), ("B", 0), ("D", 1), ("A", 2), (None, None), (None, None), (None, None), (None, None)]
    last = one(spark, ["Answer: A\nno\nfinal answer：(b) x", "x\n**C**\n \n", "x\n(d).", "answer c", None], tx.last_answer(t))
    assert last == [("B",), ("C",), ("D",), (None,), (None,)]


def test_mirror(spark):
    t = F.col("t")
    words = ["turn anti-clockwise", "anticlockwise", "leftover rights", "LeFt of LEFT", "Left, rightmost, Counterclockwise", "leftwards", None]
    assert one(spark, words, tx.mirrored(t)) == [("turn clockwise",), ("clockwise",), ("leftover rights",), ("Right of RIGHT",), ("Right, leftmost, Clockwise",), ("rightwards",), (None,)]
    assert one(spark, ["a sign", "signs", "all right", "right"], tx.mirror_eligible(t)) == [(False,), (True,), (False,), (True,)]


def test_parsers(spark):
    t = F.col("t")
    q = ["Q? Options: A: a, B: b; C：c. D: d.", "Q Options: A : a, B: b, C: c, D: d", "Q Options: A: a, B: , C: c, D: d", "Q", "QOptions : A. x  B: y", "Q Options: z A: x, B: y", None]
    assert one(spark, q, tx.strict_options(t), tx.parse_error(t)) == [(["a", "b", "c", "d"], None), (None, "labels"), (None, "empty"), (None, "marker"), (None, "marker"), (None, "labels"), (None, "marker")]
    assert [x[0] for x in one(spark, q, tx.lenient_options(t))][3:] == [None, ["x", "y"], None, None]


def rx(name):
    return re.compile(lx.PATTERNS[name], re.I)


def refs(text):
    found = [(m.start(), m.group()) for n in ("image_index", "image_ordinal") for m in rx(n).finditer(text)]
    return [(a, num(x)) for a, x in sorted(found)]


def num(x):
    x = x.lower()
    head = re.match(lx.ORD + r"(?=\s)", x)
    w = head.group() if head else re.search(f"({lx.NUM})$", x).group()
    return lx.ORD_VALUE.get(w) or int(w)


def anchor(stem):
    near = lambda at, n: next((r for _, r in refs(stem[at : at + n].split("?")[0])), None)
    for m in rx("camera_self").finditer(stem):
        inside = refs(m.group())
        if inside or near(m.end(), 80) is not None:
            return inside[0][1] if inside else near(m.end(), 80)
    for c in re.split(r"[,;()]|(?<=[.?])\s", stem):
        if rx("front_def").search(c) and rx("front_by_camera").search(c) and refs(c):
            return refs(c)[0][1]
    return next((near(m.end(), 60) for m in rx("relative").finditer(stem) if near(m.end(), 60) is not None), None)


def tags(stem, opts, n_images):
    s = lambda n: bool(rx(n).search(stem))
    o = lambda n: [bool(rx(n).search(x)) for x in opts]
    half = lambda n: sum(o(n)) >= len(opts) / 2
    space = next(
        n
        for n, c in (
            ("axis_sign", half("axes")), ("order", s("order_stem") or sum(o("order_option")) >= 2), ("statement", s("statement_stem")), ("compass", half("compass")), ("angle", half("angle")),
            ("metric", s("metric_stem") or any(o("sometimes"))), ("count", sum(o("numeric_option")) >= 3 or s("count_stem")), ("route", half("route")), ("ego_direction", half("ego")), ("entity", True),
        )
        if c
    )
    front = [c for c in re.split(r"[,;()]|(?<=[.?])\s", stem) if rx("front_def").search(c)]
    by_camera = any(rx("front_by_camera").search(c) for c in front)
    directed = space in ("ego_direction", "angle", "route")
    me = s("camera_self") or (s("self_ref") and bool(refs(stem)))
    frame = next(
        n
        for n, c in (
            ("axes", s("axes") or space == "axis_sign"), ("compass", s("compass") or half("compass")), ("agent", s("agent")), ("object_front", front and not by_camera),
            ("camera", me or by_camera or directed and (s("camera_word") or s("image_as_place"))), ("object_unspecified", directed and s("object_ref")),
            ("viewer_implicit", directed or space in ("entity", "statement") and s("direction_query")), ("none", True),
        )
        if c
    )
    at = anchor(stem) if frame in ("camera", "axes", "compass", "agent") else None
    cam = s("cam_motion") and space in ("ego_direction", "route", "statement", "entity", "angle")
    obj = s("obj_motion") and not cam
    whole = " ".join([stem, *opts])
    unsafe = [r for r, n in (("axes", "axes"), ("text_or_chiral", "text_or_chiral"), ("handedness", "handedness"), ("traffic", "traffic"), ("mirror_in_scene", "mirror_scene")) if rx(n).search(whole)]
    rewrite = [r for r, n, w in (("left_right_in_stem", "left_right", stem), ("east_west", "east_west", whole), ("rotation_sense", "rotation_sense", whole)) if rx(n).search(w)]
    order = [r for r, c in (("order_question", space == "order"), ("motion", cam or obj), ("temporal_reference", s("temporal_ref") or any(o("temporal_ref")))) if c]
    label = ["ordinal_image_reference"] if s("image_ordinal") or any(o("image_ordinal")) else ["sequence_stated"] if s("image_sequence") else []
    return {
        "answer_space": space, "frame": frame, "anchor_image": n_images if at == "last" else at, "op_camera_motion": cam, "op_object_motion": obj,
        "n_declarative": sum(not x.rstrip().endswith("?") for x in re.split(r"(?<=[.?!])\s+", stem) if x.strip()), "n_parenthetical": len(re.findall(r"\([^)]*\)", stem)),
        "mirror_level": "unsafe" if unsafe else "rewrite_stem" if rewrite else "swap_options" if any(o("left_right")) else "no_change",
        "mirror_reasons": ";".join(unsafe or rewrite or ["left_right_in_options"] * any(o("left_right"))),
        "reorder_level": "safe" if s("shuffled") else "unsafe" if order else "label_dependent" if label else "safe",
        "reorder_reasons": "order_declared_shuffled" if s("shuffled") else ";".join(order or label),
        "op_cross_view_explicit": s("cross_view") or len({r for _, r in refs(stem)}) >= 2, "f_camera_self": me, "img_index": s("image_index"), "ud_in_options": any(o("up_down")), "hedge": s("hedge"), "cap_rig": s("rig"),
    }


def test_tags_equal_a_version_row_by_row(spark):
    rows = [(i * 100 + k, s, list(o), 2 + (i + k) % 5) for i, s in enumerate(qs.STEMS) for k, o in enumerate(qs.OPTIONS)]
    df = spark.createDataFrame(rows, "id int, stem string, opts array<string>, n_images int")
    got = {x["id"]: x.asDict() for x in lx.tag_questions(df).collect()}
    assert len(next(iter(got.values()))) == 46
    spaces, anchors = set(), set()
    for i, s, o, n in rows:
        want = tags(s, o, n)
        assert {k: got[i][k] for k in want} == want, (s, o)
        spaces.add(want["answer_space"])
        anchors.add(want["anchor_image"])
    assert len(spaces) >= 9 and {1, 2, None} <= anchors


@pytest.mark.parametrize("text", ["In the second image, and in Image 3, then the last picture", "first image 10 two", "ximage 1 image 1", "", "photographs two; frame03"])
def test_image_references(spark, text):
    got = one(spark, [text], lx.image_references(F.col("t")))[0][0]
    assert [(r["start"], r["image"]) for r in got] == [(a, str(v)) for a, v in refs(text)]

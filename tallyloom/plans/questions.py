"""Multiple-choice questions, options, answers and variants, over questions drawn for every document.

The driver's tables have no questions, so each document is dealt a stem, options and a form by a hash of its id; all
queries here run over all documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import lexicon, options as op, text as tx
from tallyloom.functions.rng import letter, u32
from tallyloom.plans.registry import L, U, query, r6
from tallyloom.sources.readers import table

STEMS = [
    "Where is the chair in the second image?", "Which way should I turn left or right to reach the door?", "When you took the first photo, which direction was the lamp relative to you?",
    "How many cups are in image 3 and image 2?", "What is the order in which the pictures were taken?", "Which of the two walls is closer, in meters?", "By what angle did the camera turn clockwise between frame 1 and the last frame?",
    "If the front of the sofa is considered as north, where is the table?", "Taking the door in image 2 as the front, what is on the left side?", "Suppose a person is sitting on the bed and facing east. What is behind them?",
    "Which of the following statements is true about the first one?", "The images are shuffled. Is the sign written on the wall the same in both photos?", "Are the cars moving on the road (as seen by the dashcam)?",
    "From the position in the last image, which way is the sink?", "In the coordinate system of the room, where does the x-axis point?", "In the mirror, where is the bottle relative to the plant?",
    "The robot used its left gripper before the final picture; what happened next?", "Do these two photos overlap, and how many chairs are there in total?", "Continuous shots show a hall. How does the camera move?",
    "What is likely true of the same place in figure two?", "When I see the scene at the moment of the third photograph, what is on my right?", "Relative to the lamp, the rug is at the clockwise side; where is the cat in the Fifth picture?",
    "Turn anti-clockwise at the leftmost door, then go right. What do you see?", "Text without any reference",
]
OPTIONS = [
    ("red chair", "blue table", "lamp", "green sofa"), ("Left", "Sometimes left", "Cannot be determined", "Right"), ("North", "South", "East", "a chair"), ("1", "2", "3", "four"),
    ("first, second, third", "third, then second", "second then first", "first"), ("2 m", "3.5 m", "10 cm", "about 4 meters"), ("30 degrees", "45 degrees", "right angle", "90 degrees clockwise"),
    ("go straight and turn left", "turn right", "walk to the door", "look up"), ("Front left", "front right", "back left", "Back right"), ("+X", "-Y", "+Z", "the axis of the room"),
    ("the cat sat on the mat", "the dog is on the left now", "both are possible", "none of the above"), ("right-hand rule", "left hand", "rear door", "above"), ("northeast", "southwestern", "west", "in most cases east"),
    ("image 2", "the last photo", "the first one", "picture one"), ("zero", "ten", "7.5", "12"), ("leftmost", "RIGHT", "Clockwise", "counter-clockwise"),
]
ANSWERS = [
    "``{}`` because", "`{}`", "{{{}}} it is", "A chair is left of {}", "The cat. A small dog sits. ``{}``", "It could be {} or so", "{}", "no idea at all", "Answer: A\nno wait\nFinal answer: ({})",
    "answer：{}", "first line\n\n**{}**\n", "the answer is ({}).", "I B c said {} twice", "**({}).**", "A b C d {}e", "So it is\n  {})  \n\n",
]
TRACES = [
    "1. Look at the door.\n2. Then turn.", "So the lamp is farther from the other photo.", "The car moved; this shows that Figure 2 is last.", "You can see it on your left, between them.", "nothing here", "After that, in sequence, it rotates.",
    "Thus, when you turn, the higher shelf is next.", "1) one\n\n 2) two",
]
CELLS = [None, "", " nan ", "2.0", "12.0", "2.05", "Yes", "FALSE", "1", "None", " y ", "maybe", "True", "0"]
MENTIONS = ["", "red chair (Furniture); the Lamp (light )", "no type; door 2 (opening)", "12 (digit); big rear Door (Opening); big rear Door (opening)", "x y z(k)", "a (b) (c); ; d ()"]

_sql = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_sql, xs)) + "]"


def _pick(xs: list, k: str) -> str:
    return f"{_list(xs)}[({U(f"'{k}|' || doc_id")} % {len(xs)} + 1)::INT]"


def _drawn(xs: list, k: str, key: str = "doc_id"):
    one = lambda x: F.array(*map(F.lit, x)) if isinstance(x, tuple) else F.lit(x)
    return F.element_at(F.array(*map(one, xs)), (u32(k, F.col(key)) % len(xs) + 1).cast("int"))


_O = ", ".join(_list(x) for x in OPTIONS)
_Q = f"""q0 AS (SELECT doc_id AS id, {_pick(STEMS, "stem")} AS s0, [{_O}][({U("'opts|' || doc_id")} % {len(OPTIONS)} + 1)::INT] AS o0, {U("'form|' || doc_id")} % 8 AS form, {L("'gold|' || doc_id")} AS gold, (2 + {U("'img|' || doc_id")} % 9)::INT AS n_images FROM documents),
q AS (SELECT id, gold, n_images, CASE WHEN form < 4 THEN s0 || ' Options: A: ' || o0[1] || ', B: ' || o0[2] || ', C: ' || o0[3] || ', D: ' || o0[4] WHEN form = 4 THEN s0 || 'Options:A：' || o0[1] || '.; B：' || o0[2] || ' C：' || o0[3] || ',D：' || o0[4] || '.'
  WHEN form = 5 THEN s0 || ' Options: A: ' || o0[1] || ', B: ' || o0[2] || ', C: ' || o0[3] WHEN form = 6 THEN s0 ELSE s0 || ' Options : A. ' || o0[1] || ' B. ' || o0[2] || ', C. ' || o0[3] || ' D. ' || o0[4] END AS question FROM q0)"""


def asked(spark, sf):
    """``id, question, gold, n_images`` for every document."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _drawn(STEMS, "stem").alias("s"), _drawn(OPTIONS, "opts").alias("o"), (u32("form", F.col("doc_id")) % 8).alias("form"), letter("gold", F.col("doc_id")).alias("gold"), (2 + u32("img", F.col("doc_id")) % 9).cast("int").alias("n_images"))
    labelled = lambda parts: F.concat(F.col("s"), *[F.lit(x) if isinstance(x, str) else F.get("o", F.lit(x)) for x in parts])
    q = F.when(F.col("form") < 4, labelled([" Options: A: ", 0, ", B: ", 1, ", C: ", 2, ", D: ", 3])).when(F.col("form") == 4, labelled(["Options:A：", 0, ".; B：", 1, " C：", 2, ",D：", 3, "."]))
    q = q.when(F.col("form") == 5, labelled([" Options: A: ", 0, ", B: ", 1, ", C: ", 2])).when(F.col("form") == 6, F.col("s")).otherwise(labelled([" Options : A. ", 0, " B. ", 1, ", C. ", 2, " D. ", 3]))
    return d.select("id", q.alias("question"), "gold", "n_images")


def parsed(spark, sf):
    q = F.col("question")
    return asked(spark, sf).select("id", "gold", "n_images", "question", tx.stem(q).alias("stem"), tx.strict_options(q).alias("opts"), tx.parse_error(q).alias("error"))


def good(spark, sf):
    return parsed(spark, sf).where("error IS NULL")


#: A label after the start or one of a few characters, without looking behind; ends are stripped step by step.
_P = rf"""{_Q}, p AS (SELECT *, len(regexp_split_to_array(question, '\s*Options:\s*')) > 1 AS marked, trim(regexp_split_to_array(question, '\s*Options:\s*')[1]) AS s1, regexp_split_to_array(question, '\s*Options:\s*')[2] AS body FROM q),
m AS (SELECT *, array_to_string(regexp_extract_all(body, '(?:^|[\s,.;])([A-D])[:：]\s*', 1), '') AS labels,
  list_transform(regexp_split_to_array(regexp_replace(' ' || body, '([\s,.;])([A-D])[:：]\s*', '\1§', 'g'), '§')[2:], lambda x: trim(rtrim(trim(x), ',;.'))) AS o1 FROM p),
e AS (SELECT *, CASE WHEN NOT marked THEN 'marker' WHEN labels <> 'ABCD' THEN 'labels' WHEN len(list_filter(o1, lambda x: x = '')) > 0 THEN 'empty' END AS error, CASE WHEN marked THEN s1 END AS stem FROM m),
g AS (SELECT id, gold, n_images, question, stem, o1 AS opts FROM e WHERE error IS NULL)"""


@query(f"WITH {_P} SELECT id, stem, error, CASE WHEN error IS NULL THEN o1[1] END AS opt_a, CASE WHEN error IS NULL THEN o1[2] END AS opt_b, CASE WHEN error IS NULL THEN o1[3] END AS opt_c, CASE WHEN error IS NULL THEN o1[4] END AS opt_d FROM e")
def mcq_parse_strict(spark, sf):
    return parsed(spark, sf).select("id", "stem", "error", *[F.get("opts", F.lit(i)).alias(f"opt_{c}") for i, c in enumerate("abcd")])


_LEN = rf"""{_Q}, b AS (SELECT *, regexp_split_to_array(question, 'Options\s*:\s*')[1] AS s, regexp_split_to_array(question, 'Options\s*:\s*')[2] AS body FROM q),
c AS (SELECT *, array_to_string(regexp_extract_all(body, '(?:^|,\s*|\s+)([A-D])\s*[:.]\s+', 1), '') AS labels, regexp_split_to_array(regexp_replace(body, '(^|,\s*|\s+)([A-D])\s*[:.]\s+', '§', 'g'), '§') AS pieces FROM b),
l AS (SELECT *, CASE WHEN labels IN ('AB', 'ABC', 'ABCD') AND trim(pieces[1]) = '' THEN list_transform(pieces[2:], lambda x: trim(rtrim(trim(x), ','))) END AS opts FROM c)"""


@query(f"WITH {_LEN} SELECT id, len(opts) AS n_options, s || 'Options: ' || array_to_string(list_transform(opts, lambda x, i: substr('ABCD', i, 1) || ': ' || x), ', ') AS rebuilt FROM l")
def mcq_parse_lenient(spark, sf):
    q = asked(spark, sf).select("id", F.get(F.split("question", tx.LENIENT_MARK, 2), F.lit(0)).alias("s"), tx.lenient_options(F.col("question")).alias("opts"))
    return q.select("id", F.when(F.col("opts").isNotNull(), F.size("opts")).cast("long").alias("n_options"), tx.rebuilt(F.col("s"), F.col("opts")).alias("rebuilt"))


_I = "(?i)"
_pat = lambda n: "'" + (_I + lexicon.PATTERNS[n]).replace("'", "''") + "'"
_FAM = (
    f"CASE WHEN regexp_matches(o, {_pat('sometimes')}) THEN 'sometimes' WHEN regexp_matches(o, {_pat('abstain')}) THEN 'abstain' WHEN regexp_matches(o, {_pat('numeric_option')}) THEN 'number' "
    rf"WHEN regexp_matches(o, {_pat('order_option')}) OR regexp_matches(o, '(?i)^(?:first|second|third|fourth)(?:\s+(?:image|picture|photo|one))?$') THEN 'order' "
    f"WHEN regexp_matches(o, {_pat('compass')}) THEN 'compass' WHEN regexp_matches(o, {_pat('angle')}) THEN 'angle' "
    r"WHEN regexp_matches(regexp_replace(o, '(?i)\bright(-hand|\s+angle)', ' ', 'g'), '(?i)\b(left|right|front|back|behind|rear\w*|forward|backward|ahead|up|down|upward|downward|upper|lower|above|below|not moving|stationary|no movement|same position)\b') THEN 'ego' "
    "WHEN len(regexp_extract_all(lower(o), '[a-z0-9]+(?:''[a-z]+)?')) >= 5 THEN 'statement' ELSE 'entity' END"
)
_ONE = "SELECT id, stem, gold, unnest(['A','B','C','D']) AS letter, unnest(opts) AS o FROM g"


@query(f"WITH {_P} SELECT id, letter, {_FAM} AS family FROM ({_ONE})")
def option_family(spark, sf):
    o = good(spark, sf).select("id", F.posexplode("opts").alias("i", "o"))
    return o.select("id", F.substring(F.lit("ABCD"), F.col("i") + 1, F.lit(1)).alias("letter"), tx.option_family(F.col("o")).alias("family"))


_T = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+(?:''[a-z]+)?'))"
_ALL = "regexp_extract_all(lower(o), '[a-z0-9]+(?:''[a-z]+)?')"
_CHANCE = "CASE WHEN abs({x} - {f}({x}) OVER (PARTITION BY id)) <= 1e-8 + 1e-5 * abs({f}({x}) OVER (PARTITION BY id)) THEN 1 ELSE 0 END"


@query(f"""WITH {_P}, v AS (SELECT id, gold, letter, len({_ALL})::DOUBLE AS n, len(list_intersect({_T('o')}, {_T('stem')})) / len(list_distinct(list_concat({_T('o')}, {_T('stem')})))::DOUBLE AS j FROM ({_ONE})),
h AS (SELECT id, gold, letter, {_CHANCE.format(x='n', f='max')} AS a, {_CHANCE.format(x='n', f='min')} AS b, {_CHANCE.format(x='j', f='max')} AS c FROM v), w AS (SELECT id, gold, letter, a / sum(a) OVER (PARTITION BY id) AS a, b / sum(b) OVER (PARTITION BY id) AS b, c / sum(c) OVER (PARTITION BY id) AS c FROM h)
SELECT id, letter, round(a, 6) AS longest, round(b, 6) AS shortest, round(c, 6) AS overlap, round(sum(CASE WHEN letter = gold THEN a ELSE 0 END) OVER (PARTITION BY id), 6) AS longest_score FROM w""")
def heuristic_policies(spark, sf):
    q = good(spark, sf).select("id", "gold", op.extremum_policy(op.lengths(F.col("opts"))).alias("a"), op.extremum_policy(op.lengths(F.col("opts")), smallest=True).alias("b"), op.extremum_policy(op.overlaps(F.col("opts"), F.col("stem"))).alias("c"))
    o = q.select("id", op.policy_score(F.col("a"), F.col("gold")).alias("s"), F.posexplode(F.arrays_zip("a", "b", "c")).alias("i", "p"))
    return o.select("id", F.substring(F.lit("ABCD"), F.col("i") + 1, F.lit(1)).alias("letter"), r6("p.a").alias("longest"), r6("p.b").alias("shortest"), r6("p.c").alias("overlap"), r6("s").alias("longest_score"))


@query(f"""WITH {_P}, f AS (SELECT id, letter, o, {_FAM} AS family FROM ({_ONE})), n AS (SELECT *, count(*) OVER (PARTITION BY id, family) AS mine FROM f),
x AS (SELECT id, letter, regexp_matches(o, {_pat('sometimes')}) AS sometimes, regexp_matches(o, {_pat('abstain')}) AS abstain, mine = 1 AND max(mine) OVER (PARTITION BY id) = 3 AS outlier FROM n), y AS (SELECT *, sometimes OR abstain OR outlier AS gone FROM x)
SELECT id, letter, sometimes, abstain, outlier, round(CASE WHEN count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY id) = 0 THEN 0.25 WHEN gone THEN 0 ELSE 1.0 / count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY id) END, 6) AS chance FROM y""")
def elimination_policy(spark, sf):
    fam = F.transform("opts", tx.option_family)
    q = good(spark, sf).select("id", "opts", fam.alias("fam"))
    n = lambda x: F.size(F.filter("fam", lambda y: y == x))
    modal = F.exists("fam", lambda x: n(x) == 3)
    rules = F.transform("opts", lambda x, i: F.struct(lexicon.has(x, "sometimes").alias("sometimes"), lexicon.has(x, "abstain").alias("abstain"), (F.col("modal") & (n(F.get("fam", i)) == 1)).alias("outlier")))
    q = q.withColumn("modal", modal).withColumn("rules", rules)
    q = q.select("id", F.posexplode(F.arrays_zip("rules", op.elimination_policy(F.transform("rules", lambda r: r["sometimes"] | r["abstain"] | r["outlier"])).alias("p"))).alias("i", "x"))
    return q.select("id", F.substring(F.lit("ABCD"), F.col("i") + 1, F.lit(1)).alias("letter"), "x.rules.*", r6("x.p").alias("chance"))


@query(f"WITH {_P} SELECT id, s.s AS shift, opts[(s.s) % 4 + 1] AS first_shown, opts[(3 + s.s) % 4 + 1] AS last_shown, substr('ABCD', (position(gold IN 'ABCD') - 1 - s.s + 4) % 4 + 1, 1) AS shown_gold FROM g CROSS JOIN (SELECT unnest([0,1,2,3])::INT AS s) s")
def rotate_options(spark, sf):
    r = good(spark, sf).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(3))))
    shown = op.rotated(F.col("opts"), F.col("shift"))
    at = (F.instr(F.lit("ABCD"), F.col("gold")) - 1 - F.col("shift") + 4) % 4 + 1
    return r.select("id", "shift", F.get(shown, F.lit(0)).alias("first_shown"), F.get(shown, F.lit(3)).alias("last_shown"), F.substring(F.lit("ABCD"), at.cast("int"), F.lit(1)).alias("shown_gold"))


@query(f"WITH {_P} SELECT id, stem || chr(10) || array_to_string(opts, ' ') AS question_text, least(n_images, 3) AS clipped, CASE WHEN n_images >= 3 THEN '3+' ELSE n_images::VARCHAR END AS bin FROM g")
def question_text(spark, sf):
    n = F.least("n_images", F.lit(3))
    return good(spark, sf).select("id", F.concat_ws("\n", "stem", F.array_join("opts", " ")).alias("question_text"), n.alias("clipped"), F.when(n == 3, "3+").otherwise(F.col("n_images").cast("string")).alias("bin"))


_LOGIT = f"list_transform([0,1,2,3], lambda i: ('0x' || substr(md5('lg|' || i || '|' || id), 1, 8))::BIGINT % 1000 / 200.0)"


@query(f"WITH {_Q}, l AS (SELECT id, gold, {_LOGIT} AS v FROM q), e AS (SELECT id, gold, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM l) SELECT id, round(e[position(gold IN 'ABCD')] / list_sum(e), 6) AS gold_chance, round(1 / list_sum(e), 6) AS best_chance FROM e")
def option_softmax(spark, sf):
    v = F.array(*[(u32("lg", i, F.col("id")) % 1000) / 200.0 for i in range(4)])
    q = asked(spark, sf).select("id", "gold", op.softmax(v).alias("p"))
    return q.select("id", r6(op.policy_score(F.col("p"), F.col("gold"))).alias("gold_chance"), r6(F.array_max("p")).alias("best_chance"))


_A = f"SELECT doc_id, replace(replace(replace({_pick(ANSWERS, 'ans')}, '{{{{', '<'), '}}}}', '>'), '{{}}', {L("'pred|' || doc_id")}) AS t0 FROM documents"
_LONE = r"(i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '\w')) AND NOT regexp_matches(substr(t, i + 1, 1), '\w') AND NOT regexp_matches(substr(t, i + 1, 2), '^\s[a-zA-Z]')"


@query(rf"""WITH a AS ({_A}), x AS (SELECT doc_id, replace(replace(t0, '<', '{{'), '>', '}}') AS t FROM a), y AS (SELECT doc_id, t, nullif(regexp_extract(t, '``([A-D])``', 1), '') AS r0, nullif(regexp_extract(t, '`([A-D])`', 1), '') AS r1, nullif(regexp_extract(t, '[{{]([A-D])[}}]', 1), '') AS r2,
substr(t, list_filter(range(1, length(t) + 1), lambda i: position(substr(t, i, 1) IN 'ABCD') > 0 AND {_LONE})[1]::INT, 1) AS r3, regexp_extract_all(t, '(?i)(?:final\s+answer|answer)\s*[:：]\s*\(?([A-D])\)?\b', 1) AS f, list_filter(list_transform(string_split(t, chr(10)), lambda z: trim(z)), lambda z: z <> '') AS l FROM x)
SELECT doc_id, coalesce(r0, r1, r2, r3) AS answer, CASE WHEN r0 IS NOT NULL THEN 0 WHEN r1 IS NOT NULL THEN 1 WHEN r2 IS NOT NULL THEN 2 WHEN r3 IS NOT NULL THEN 3 END AS rule, upper(coalesce(f[len(f)], nullif(regexp_extract(l[len(l)], '(?i)^(?:\*\*)?\(?([A-D])\)?[.)]?(?:\*\*)?$', 1), ''))) AS last FROM y""")
def answer_ladder(spark, sf):
    form = F.replace(F.replace(_drawn(ANSWERS, "ans"), F.lit("{{"), F.lit("<")), F.lit("}}"), F.lit(">"))
    t = F.replace(F.replace(F.replace(form, F.lit("{}"), letter("pred", F.col("doc_id"))), F.lit("<"), F.lit("{")), F.lit(">"), F.lit("}"))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", tx.answer(F.col("t")).alias("answer"), tx.answer_rule(F.col("t")).alias("rule"), tx.last_answer(F.col("t")).alias("last"))


_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in tx.MIRROR_MAP.items()) + "}"
_MW = tx.MIRROR_WORDS.replace("(counter", "(?:counter", 1)
_TURN = f"CASE WHEN w = upper(w) THEN upper({_MAP}[lower(w)]) WHEN substr(w, 1, 1) = upper(substr(w, 1, 1)) THEN upper(substr({_MAP}[lower(w)], 1, 1)) || substr({_MAP}[lower(w)], 2) ELSE {_MAP}[lower(w)] END"
_MIRRORED = f"array_to_string(list_transform(regexp_split_to_array(question, '{_MW}'), lambda x, i: x || coalesce(list_transform(regexp_extract_all(question, '{_MW}'), lambda w: {_TURN})[i], '')), '')"


@query(f"WITH {_Q} SELECT id, {_MIRRORED} AS mirrored, regexp_matches(question, '{_MW}') AS has_direction, NOT regexp_matches(question, '{tx.MIRROR_BLOCK}') AS eligible FROM q")
def mirror_swap(spark, sf):
    q = F.col("question")
    return asked(spark, sf).select("id", tx.mirrored(q).alias("mirrored"), tx.has_direction(q).alias("has_direction"), tx.mirror_eligible(q).alias("eligible"))


@query(f"WITH t AS (SELECT doc_id, text || chr(10) || {_pick(TRACES, 'trace')} AS t FROM documents) SELECT doc_id, " + ", ".join(f"regexp_matches(t, '{p}') AS {n}" for n, p in tx.CUES.items()) + " FROM t")
def cue_flags(spark, sf):
    """Step cues of every text with a drawn trace behind it."""
    t = table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", "text", _drawn(TRACES, "trace")).alias("t"))
    return t.select("doc_id", *[F.col("t").rlike(p).alias(n) for n, p in tx.CUES.items()])


@query()
def lexicon_tags(spark, sf):
    """All tags of every question that parses; looking around keeps them out of DuckDB's SQL."""
    return lexicon.tag_questions(good(spark, sf))


_VAL = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in lexicon.ORD_VALUE.items()) + "}"
_AT = f"list_filter(range(1, length(s) + 1), lambda i: (i = 1 OR NOT regexp_matches(substr(s, i - 1, 1), '\\w')) AND regexp_matches(substr(s, i), '(?i)^(?:{lexicon._REF})'))"
_VALUE = f"coalesce({_VAL}[lower(regexp_extract(substr(s, i), '(?i)^{lexicon.ORD}'))], {_VAL}[lower(regexp_extract(r, '(?i)({lexicon.NUM})$', 1))], regexp_extract(r, '(\\d+)$', 1))"


@query(f"WITH {_Q}, s AS (SELECT id, question AS s FROM q), x AS (SELECT id, s, unnest({_AT}) AS i FROM s), y AS (SELECT id, s, i, regexp_extract(substr(s, i), '(?i)^(?:{lexicon._REF})') AS r FROM x), z AS (SELECT id, string_agg((i - 1) || ':' || {_VALUE}, ',' ORDER BY i) AS refs FROM y GROUP BY 1) SELECT s.id, coalesce(refs, '') AS refs FROM s LEFT JOIN z ON z.id = s.id")
def image_references(spark, sf):
    refs = F.transform(lexicon.image_references(F.col("question")), lambda r: F.concat_ws(":", r["start"].cast("string"), r["image"]))
    return asked(spark, sf).select("id", F.array_join(refs, ",").alias("refs"))


_TURNED = "list_transform(range(1, len(opts) + 1), lambda i: opts[((i - 1 + 1 + k % (len(opts) - 1)) % len(opts) + 1)::INT])"
_NOTE = "Note: the images are not shown in numerical order; refer to each image by its label.\n"


@query(f"""WITH {_LEN}, k AS (SELECT *, {U("'turn|' || id")} AS k FROM l), v AS (SELECT id, 'orig' AS variant, question FROM k UNION ALL SELECT id, 'mirror', {_MIRRORED} FROM k WHERE NOT regexp_matches(question, '{tx.MIRROR_BLOCK}') UNION ALL SELECT id, 'reorder', question || chr(10) || '{_NOTE.strip()}' FROM k WHERE n_images >= 4
UNION ALL SELECT id, 'shuffle', s || 'Options: ' || array_to_string(list_transform({_TURNED}, lambda x, i: substr('ABCD', i, 1) || ': ' || x), ', ') FROM k WHERE opts IS NOT NULL) SELECT id, variant, question FROM v""")
def variant_fan_out(spark, sf):
    """Each question as it is, mirrored where that keeps the answer, with images reordered (here from four on), and with
    its options moved on by a drawn number of places."""
    q = asked(spark, sf).select("id", "question", "n_images", F.get(F.split("question", tx.LENIENT_MARK, 2), F.lit(0)).alias("s"), tx.lenient_options(F.col("question")).alias("opts"), u32("turn", F.col("id")).alias("k"))
    n = F.size("opts")
    moved = F.transform("opts", lambda x, i: F.get("opts", ((i + 1 + F.col("k") % (n - 1)) % n).cast("int")))
    variants = F.array(
        F.struct(F.lit("orig").alias("variant"), F.col("question").alias("question")),
        F.struct(F.lit("mirror").alias("variant"), F.when(tx.mirror_eligible(F.col("question")), tx.mirrored(F.col("question"))).alias("question")),
        F.struct(F.lit("reorder").alias("variant"), F.when(F.col("n_images") >= 4, F.concat_ws("\n", "question", F.lit(_NOTE.strip()))).alias("question")),
        F.struct(F.lit("shuffle").alias("variant"), F.when(F.col("opts").isNotNull(), tx.rebuilt(F.col("s"), moved)).alias("question")),
    )
    return q.select("id", F.explode(F.filter(variants, lambda v: v["question"].isNotNull())).alias("v")).select("id", "v.*")


_BLANK = r"CASE WHEN lower(trim(coalesce(c, ''))) IN ('', 'nan', 'none') THEN '' WHEN regexp_full_match(trim(c), '\d+\.0') THEN split_part(trim(c), '.', 1) ELSE trim(c) END"
_MENT = r"list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(m, ';'), lambda x: trim(x)), lambda x: regexp_full_match(x, '.*?\s*\([^)]+\)') AND len(regexp_extract_all(lower(regexp_extract(x, '^(.*?)\s*\(([^)]+)\)\s*$', 1)), '[a-z]+')) > 0), lambda x: list_last(regexp_extract_all(lower(regexp_extract(x, '^(.*?)\s*\(([^)]+)\)\s*$', 1)), '[a-z]+')) || '/' || lower(trim(regexp_extract(x, '^(.*?)\s*\(([^)]+)\)\s*$', 2))))))"


@query(f"WITH t AS (SELECT doc_id, {_pick(CELLS, 'cell')} AS c, {_pick(MENTIONS, 'ment')} AS m FROM documents), b AS (SELECT doc_id, c, {_BLANK} AS b, {_MENT} AS ms FROM t) SELECT doc_id, b AS blank, CASE WHEN lower(b) IN ('yes', 'true', '1') THEN 'yes' WHEN lower(b) IN ('no', 'false', '0') THEN 'no' ELSE lower(b) END AS yes, CASE WHEN trim(coalesce(c, '')) <> '' THEN lower(trim(c)) IN ('y', 'yes', 'true', '1') END AS truthy, array_to_string(ms, ',') AS mentions FROM b")
def annotation_cells(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _drawn(CELLS, "cell").alias("c"), _drawn(MENTIONS, "ment").alias("m"))
    c = F.col("c")
    return d.select("doc_id", tx.blank(c).alias("blank"), tx.yes_no(c).alias("yes"), tx.truthy(c).alias("truthy"), F.array_join(tx.mentions(F.col("m")), ",").alias("mentions"))


@query(f"""WITH {_P}, t AS (SELECT doc_id, unnest({_T('text')}) AS token FROM documents), c AS (SELECT t.token, count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS ok FROM t JOIN labels l ON l.doc_id = t.doc_id GROUP BY 1),
o AS (SELECT id, unnest([0, 1, 2, 3]) AS i, unnest(opts) AS opt FROM g), w AS (SELECT id, i, unnest({_T('opt')}) AS token FROM o),
pr AS (SELECT w.id, w.i, round(avg(coalesce(ln((c.ok + 1) / (c.n - c.ok + 3)), ln(1.0 / 3))), 9) AS v FROM w LEFT JOIN c ON c.token = w.token GROUP BY 1, 2), mx AS (SELECT *, max(v) OVER (PARTITION BY id) AS top FROM pr), h AS (SELECT *, (abs(v - top) <= 1e-8 + 1e-5 * abs(top))::INT AS hit FROM mx)
SELECT id, substr('ABCD', i + 1, 1) AS letter, round(hit / sum(hit) OVER (PARTITION BY id), 6) AS chance FROM h""")
def content_prior_policy(spark, sf):
    """Options by the mean log-odds of their tokens among labelled documents; unseen tokens count ln(1/3)."""
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    c = t.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("ok"))
    w = good(spark, sf).select("id", F.posexplode("opts").alias("i", "opt")).select("id", "i", F.explode(F.array_distinct(tx.tokens(F.col("opt")))).alias("token"))
    odds = F.coalesce(F.log((F.col("ok") + 1) / (F.col("n") - F.col("ok") + 3)), F.log(F.lit(1.0) / 3))
    p = w.join(c, "token", "left").groupBy("id", "i").agg(F.round(F.avg(odds), 9).alias("v"))
    per = p.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    return per.select("id", F.posexplode(op.extremum_policy(F.col("v"))).alias("i", "p")).select("id", F.substring(F.lit("ABCD"), F.col("i") + 1, F.lit(1)).alias("letter"), r6("p").alias("chance"))

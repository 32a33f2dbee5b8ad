"""Question tags: one projection of patterns and of the decision ladders over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the patterns below, and the numbers of number words.
IMG = r"(?:photo|picture|image|figure|frame|shot|photograph|diagram|chapter)s?"
ORD = r"(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last|final)"
NUM = r"(?:\d+|one|two|three|four|five|six)"
ORD_VALUE = {
    "first": 1, "one": 1, "second": 2, "two": 2, "third": 3, "three": 3, "fourth": 4, "four": 4, "fifth": 5, "five": 5, "sixth": 6, "six": 6,
    "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "last": "last", "final": "last",
}
#: The patterns, case-blind, by name.
PATTERNS = {
    "image_index": rf"\b{IMG}\s*{NUM}\b",
    "image_ordinal": rf"\b{ORD}\s+(?:{IMG}|one)\b",
    "image_sequence": r"\b(?:continuous\w*|consecutive\w*|in (?:succession|sequence)|succession|chronological|one after another|series of)\b",
    "left_right": r"\b(?:left|right(?!-hand|\s+angle))\b",
    "front_back": r"\b(?:front|back|behind|rear\w*|forward|backward|ahead)\b",
    "up_down": r"\b(?:up|down|upward|downward|upper|lower|above|below)\b",
    "ego": r"\b(?:left|right(?!-hand|\s+angle)|front|back|behind|rear\w*|forward|backward|ahead|"
    r"up|down|upward|downward|upper|lower|above|below|not moving|stationary|no movement|same position)\b",
    "compass": r"\b(?:north|south)(?:east|west)?(?:ern)?\b|\b(?:east|west)(?:ern)?\b",
    "east_west": r"\b(?:east|west|northeast|northwest|southeast|southwest)\b",
    "axes": r"coordinate system|right-hand|[+-][XYZ]\b|\b[XYZ][- ]?axis\b|\baxis\b|positive (?:direction|angle)|negative (?:direction|angle)",
    "rotation_sense": r"\b(?:clockwise|counterclockwise|counter-clockwise)\b",
    "angle": r"\b\d+\s*degrees?\b|\b(?:clockwise|counterclockwise|counter-clockwise|obtuse|acute|right angle)\b",
    "numeric_option": r"^(?:\d+(?:\.\d+)?|zero|one|two|three|four|five|six|seven|eight|nine|ten)$",
    "order_option": r"^(?:(?:first|second|third|fourth)(?:\s+(?:image|picture|photo|one))?(?:,\s*(?:then\s+)?|\s+then\s+)){1,3}"
    r"(?:first|second|third|fourth)(?:\s+(?:image|picture|photo|one))?$",
    "order_stem": r"\border in which\b|\bwhich (?:picture|photo|image) was taken first\b|\bsequence of the (?:photos|pictures|images)\b|\bclockwise order\b",
    "statement_stem": r"which of the following (?:\w+ ){0,2}(?:statements?|descriptions?)\b|choose the correct description",
    "metric_stem": r"\bwhich (?:\w+ ){0,3}(?:is|has|was)\s+(?:a\s+)?(?:greater|larger|smaller|higher|lower|taller|shorter|longer|wider|narrower|thicker|bigger|closer|faster)\b|"
    r"\b(?:greater|larger|smaller|higher|lower|taller|shorter|longer|wider|narrower|thicker|bigger)\b(?:\s+\w+){0,3}\s*[:,]|"
    r"\bwhich is (?:higher|taller|longer|wider|narrower|thicker|smaller|greater|larger|lower|shorter)\b|\bestimate\b|"
    r"\b(?:floor|total|surface) area\b|\barea covered\b|\bmeters?\b|\bcm\b|\bclosest in height\b|\bspeed\b|\bcloser\b|\bfarther\b|"
    r"\bradius\b|\bdiameter\b|\bplaced directly into\b|\bget stuck\b",
    "route": r"\b(?:go|going|goes|walk\w*|turn(?:ed|s)?|move forward|straight|keep going|look(?:ing)?|cannot reach|cannot see)\b",
    "abstain": r"cannot be determined|unable to determine|cannot (?:see|reach)|either is possible|both are possible|all are possible|"
    r"none of the above|both at the same time|taken at the same time",
    "sometimes": r"^(?:sometimes\b|in most cases\b)",
    "camera_self": r"\bwhen (?:you|i) (?:took|take|takes|was taking|were taking|am taking|are taking|saw|see)\b|"
    r"\bwhen (?:taking|shooting) (?:the |photo|picture|image)|\b(?:at|in) the moment (?:of|when|the)\b|"
    r"\b(?:assum\w*|suppose|if)(?: that)? (?:i|you) (?:am|are|was|were) (?:taking|shooting)\b|"
    r"\bwhen (?:i|you) (?:am|are|was|were) at the (?:location|position)\b|"
    r"\bfrom the position in the (?:first|second|last) (?:image|photo|picture)\b|\bmy current position\b|\bwhen i see the scene\b|"
    rf"\bwhen (?:the )?{ORD} {IMG} (?:is|was) taken\b|\bin the {ORD} {IMG}\b(?=[^?]*\b(?:you|me)\b)|"
    r"\bat the position and facing the direction shown\b",
    "self_ref": r"\b(?:relative to|in relation to|compared to) (?:you|me|yourself|myself|him|her|them|the person|the photographer)\b|"
    r"\bon (?:your|my) (?:left|right)\b|\b(?:behind|in front of) (?:you|me)\b|\bof you\b|\bto your\b",
    "agent": r"\b(?:when|if|suppose|assum\w*|after|as|once)(?: that)?\s+(?:you|i|a person|the person|someone|he|she|they|my friend|the homeowner)\s+"
    r"(?:(?:are|am|is|were|was)\s+)?(?:\w+ly\s+)?"
    r"(?:sit\w*|lie|lies|lying|stand\w*|enter\w*|go|goes|going|walk\w*|come|comes|coming|fac\w*|cook\w*|wash\w*|us(?:e|es|ing)|brush\w*|open\w*|look\w*|"
    r"watch\w*|work\w*|play\w*|leav\w*|step\w*|prepar\w*|dr(?:y|ies|ying)|finish\w*|want\w*|clos\w*|close to|next to|at the stair\w*)\b|"
    r"\b(?:a person|someone|the person|he|she)\s+(?:is\s+)?(?:sit\w*|lie|lying|stand\w*|enter\w*|walk\w*|com\w*|fac\w*|watch\w*|play\w*)\b|"
    r"\b(?:entering|after entering|upon entering)\b|\benter the room\b|"
    r"\b(?:going|go|walk) (?:up|down)(?:stairs| the stairs)\b|\bdirection of going (?:up|down)stairs\b|"
    r"\bwith (?:my|your|his|her) back to\b|\b(?:i|you) (?:am|are) (?:lying|sitting|standing)\b|"
    r"\bfacing (?:north|south|east|west)\b(?![^,.?]*\b(?:photo|picture|image)\b)|"
    r"\bif (?:you|someone|a person) walks?\b|\bcomes? out of\b|\bcoming down\b",
    "front_def": r"\bas the (?:front|back|forward direction)\b|\b(?:is|be|being) considered (?:as )?(?:the )?(?:front|forward|north|back)\b|"
    r"\bconsidered as the front\b|\bconsidered the front\b|\bis the front\b|\bfacing forward\b|\bfaces forward\b",
    "front_by_camera": r"\b(?:photo|picture|image|figure|shooting|taken|camera)\b",
    "object_ref": r"\b(?:relative to|in relation to|compared to|from)\s+(?:the|this|that|a)\s+(?!(?:first|second|third|fourth|fifth|sixth|last|final|current|same|opposite)\b)"
    r"(?!(?:photo|picture|image|figure|position|location|shooting|camera|photographer|direction|perspective|platform)s?\b)[a-z]",
    "camera_word": r"\b(?:camera|cameras|you|your|i|me|my|photographer|viewpoint|perspective|first-person|dashcam)\b",
    "image_as_place": rf"\b(?:position|location|place|spot)s? (?:of|where|in which) (?:the )?(?:shooting )?(?:{ORD} )?{IMG}|"
    rf"\b{IMG}(?: \d)? (?:was|were|is) taken\b|\bshooting (?:position|location)\b|\brelative to (?:the )?{ORD} {IMG}",
    "overlap": r"\boverlap\w*\b",
    "same_place": r"\bsame (?:location|position|spot|place|scene|room|house|building|site|pile)\b|\bsimilar locations\b|\b\d+ degrees apart\b|\bafter rotating\b",
    "shuffled": r"\bshuffled\b|\bscrambled\b",
    "first_person": r"\bfirst-person\b",
    "rig": r"\b(?:dashcam|in-vehicle|in-car|onboard|vehicle-mounted|head camera|wrist camera|camera on the robot|camera mounted|mounted on a moving car)\b|\bcamera facing\b",
    "hedge": r"\b(?:likely|approximately|approximate|roughly|probably|estimate|closest|most accurately|obviously|mainly)\b",
    "conditional": r"\b(?:given that|assum\w*|suppose|if)\b",
    "cam_motion": r"\b(?:camera|you|your viewpoint|viewpoint|i)\b[^.?]{0,25}?\b(?:mov\w*|rotat\w*|turn\w*)\b|\bhow did (?:i|you) (?:most likely )?move\b|"
    r"\bhow does the camera move\b|\bhow (?:was|is) this car moving\b|\bvehicle with the camera\b",
    "obj_motion": r"\b(?:is|are|did|does|do)\s+(?:the\s+)?(?!camera\b|you\b)[a-z][a-z ]{1,40}?\s(?:mov\w*|rotat\w*|turn\w*|walk\w*)\b|"
    r"\bhow (?:do|does|did|should) (?:the )?(?!camera\b)[a-z][a-z ]{1,30}?(?:move|rotate|turn)\b|\bmotion state\b|"
    r"\bmoving vehicles\b|\bin motion\b|\bprevious action\b|\bdescribes (?:his|her|its) movement\b",
    "direction_query": r"\bwhich direction\b|\bwhich side\b|\bwhere (?:is|was|are|were|would|can)\b|\bposition\b|"
    r"\b(?:to|on) the (?:left|right|north|south|east|west|northeast|northwest|southeast|southwest)\b|\bin front of\b|\bbehind\b|"
    r"\bdirectly (?:in front|behind)\b|\bwhich wall\b|\bpositional relationship\b",
    "count_stem": r"\bhow many\b|\bnumber of\b",
    "cross_view": r"\boverlap\w*\b|\bsame (?:location|position|spot|place|scene|room|house|building|site|pile|object|area)\b|\bin total\b|"
    r"\bdifferent (?:\w+ ){0,3}(?:appear|can|in|on|captured|displaying)|\btotal\b|\bthese (?:two|three|six) (?:photos|pictures|images)\b",
    "text_or_chiral": r"\bletter\b|\blabeled\b|\bwritten\b|\bwriting\b|\bsigns?\b|\buppercase\b|\bcapital\b|\b[A-Z]-shape\b|\bclock\b|\"[A-Z]+\"",
    "handedness": r"\b(?:left|right) (?:gripper|hand|wrist|arm|foot|leg)\b|\bgrippers\b|\bright-hand\b|\bin the left hand\b",
    "traffic": r"\b(?:lane|driving|dashcam|car|cars|vehicle|vehicles|road|crosswalk|traffic|toyota)\b",
    "mirror_scene": r"\breflect\w*\b|\bin the mirror\b|\bis a mirror\b|\bmirror with\b",
    "temporal_ref": rf"\b(?:last|final|next|previous) {IMG}\b|\bmoment\b|\bfrom (?:taking )?(?:the )?(?:{IMG} ?1|first {IMG}) to\b|"
    r"\bwhen (?:i|you) went from\b|\bbefore\b|\bafter\b(?! (?:you|a person|entering|leaving))",
    "relative": r"\b(?:relative to|from|in relation to|from the perspective of)\b",
}
_REF = rf"\b{IMG}\s*{NUM}\b|\b{ORD}\s+(?:{IMG}|one)\b"
_CLAUSE = r"[,;()]|(?<=[.?])\s"


def has(text: Column, name: str) -> Column:
    return text.rlike("(?i)" + PATTERNS[name])


def share(opts: Column, name: str) -> Column:
    return F.size(F.filter(opts, lambda x: has(x, name))) / F.size(opts)


def _any(opts: Column, name: str) -> Column:
    return F.exists(opts, lambda x: has(x, name))


def _value(reference: Column) -> Column:
    """What a reference says: a number as text, or ``last``; null for an empty one."""
    low = F.lower(reference)
    ordinal = F.regexp_extract(low, rf"^{ORD}(?=\s)", 0)
    word = F.when(ordinal != "", ordinal).otherwise(F.regexp_extract(low, rf"({NUM})$", 1))
    table = F.create_map(*[F.lit(str(x)) for kv in ORD_VALUE.items() for x in kv])
    return F.coalesce(table[word], F.when(word != "", F.regexp_replace(word, r"^0+(?=\d)", "")))


def image_references(text: Column) -> Column:
    """References to images in order, as structs of the offset in code points and the index (text) or ``last``.

    A reference by index may begin inside one by ordinal (``first image 2``), so references are found where a look
    ahead matches: the text is split before each, and the lengths of the parts give the offsets.
    """
    parts = F.split(text, rf"(?i)(?={_REF})")
    starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"])
    # A reference reaches into the two parts after its own at most, as an ordinal and a number may begin others inside it.
    tail = lambda k: F.slice(parts, F.lit(k), F.greatest(F.size(parts), F.lit(1)))
    join = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    seen = F.zip_with(F.zip_with(parts, tail(2), join), tail(3), join)
    both = F.zip_with(starts, seen, lambda at, x: F.struct(at.alias("start"), _value(F.regexp_extract(x, rf"(?i)^(?:{_REF})", 0)).alias("image")))
    return F.filter(both, lambda r: r["image"].isNotNull())


def first_reference(text: Column) -> Column:
    return _value(F.regexp_extract(text, rf"(?i){_REF}", 0))


def _followed(text: Column, name: str, window: int) -> tuple[Column, Column]:
    """The matches of a pattern, and for each the text after it, up to ``window`` characters or a question mark."""
    pattern = rf"(?is)({PATTERNS[name]})(?=(.{{0,{window}}}))"
    after = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.get(F.split(x, r"\?"), F.lit(0)))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), after


def anchor_image(stem: Column) -> Column:
    """The image whose camera is ``me`` or the viewpoint: index as text, ``last`` or null.

    First a phrase that puts one at a camera, with the image inside it or shortly after; then a clause that defines
    the front by an image; then the image shortly after ``relative to``, ``from`` and the like.
    """
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    at, after = _followed(stem, "camera_self", 80)
    camera = F.zip_with(at, after, lambda x, y: F.coalesce(first_reference(x), first_reference(y)))
    clauses = F.filter(F.split(stem, _CLAUSE), lambda c: has(c, "front_def") & has(c, "front_by_camera"))
    relative = F.transform(_followed(stem, "relative", 60)[1], first_reference)
    return F.coalesce(first(camera), first(F.transform(clauses, first_reference)), first(relative))


def answer_space(stem: Column, opts: Column) -> Column:
    """First match wins; a share is over the options."""
    n = lambda name: F.size(F.filter(opts, lambda x: has(x, name)))
    return (
        F.when(share(opts, "axes") >= 0.5, "axis_sign")
        .when(has(stem, "order_stem") | (n("order_option") >= 2), "order")
        .when(has(stem, "statement_stem"), "statement")
        .when(share(opts, "compass") >= 0.5, "compass")
        .when(share(opts, "angle") >= 0.5, "angle")
        .when(has(stem, "metric_stem") | (n("sometimes") > 0), "metric")
        .when((n("numeric_option") >= 3) | has(stem, "count_stem"), "count")
        .when(share(opts, "route") >= 0.5, "route")
        .when(share(opts, "ego") >= 0.5, "ego_direction")
        .otherwise("entity")
    )


def _reasons(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(c, n) for n, c in pairs]), lambda x: x.isNotNull()), ";")


def tag_questions(questions: DataFrame) -> DataFrame:
    """``questions(id, stem, opts, n_images)`` with the answer space, the frame, the anchor image, levels with their
    reasons, counts and flags. One projection after another, all in the JVM."""
    stem, opts = F.col("stem"), F.col("opts")
    space, frame = F.col("answer_space"), F.col("frame")
    whole = F.concat_ws(" ", stem, F.array_join(opts, " "))
    clauses = F.filter(F.split(stem, _CLAUSE), lambda c: has(c, "front_def"))
    sentences = F.filter(F.split(stem, r"(?<=[.?!])\s+"), lambda s: F.trim(s) != "")
    refs = F.transform(image_references(stem), lambda r: r["image"])
    q = questions.select("id", "stem", "opts", "n_images", answer_space(stem, opts).alias("answer_space"), refs.alias("refs"), whole.alias("whole"))
    q = q.withColumns(
        {
            "axes_stem": has(stem, "axes"),
            "f_compass_stem": has(stem, "compass"),
            "f_compass_options": share(opts, "compass") >= 0.5,
            "f_agent": has(stem, "agent"),
            "f_camera_self": has(stem, "camera_self") | (has(stem, "self_ref") & (F.size("refs") > 0)),
            "f_front_by_camera": F.exists(clauses, lambda c: has(c, "front_by_camera")),
            "n_front": F.size(clauses),
            "f_object_ref": has(stem, "object_ref"),
            "n_declarative": F.size(F.filter(sentences, lambda s: ~F.rtrim(s).endswith("?"))).cast("long"),
            "n_parenthetical": F.regexp_count(stem, F.lit(r"\([^)]*\)")).cast("long"),
        }
    )
    directional = space.isin("ego_direction", "angle", "route")
    q = q.withColumns(
        {
            "f_axes": F.col("axes_stem") | (space == "axis_sign"),
            "f_front_by_object": (F.col("n_front") > 0) & ~F.col("f_front_by_camera"),
            "has_premise": (F.col("n_declarative") > 0) | (F.col("n_parenthetical") > 0) | has(stem, "conditional"),
            "op_camera_motion": has(stem, "cam_motion") & space.isin("ego_direction", "route", "statement", "entity", "angle"),
        }
    )
    seen = F.col("f_camera_self") | F.col("f_front_by_camera") | (directional & (has(stem, "camera_word") | has(stem, "image_as_place")))
    q = q.withColumns(
        {
            "op_object_motion": has(stem, "obj_motion") & ~F.col("op_camera_motion"),
            "frame": F.when(F.col("f_axes"), "axes")
            .when(F.col("f_compass_stem") | F.col("f_compass_options"), "compass")
            .when(F.col("f_agent"), "agent")
            .when(F.col("f_front_by_object"), "object_front")
            .when(seen, "camera")
            .when(directional & F.col("f_object_ref"), "object_unspecified")
            .when(directional | (space.isin("entity", "statement") & has(stem, "direction_query")), "viewer_implicit")
            .otherwise("none"),
        }
    )
    anchor = F.when(frame.isin("camera", "axes", "compass", "agent"), anchor_image(stem))
    text = F.col("whole")
    unsafe = _reasons([(n, has(text, p)) for n, p in (("axes", "axes"), ("text_or_chiral", "text_or_chiral"), ("handedness", "handedness"), ("traffic", "traffic"), ("mirror_in_scene", "mirror_scene"))])
    rewrite = _reasons([("left_right_in_stem", has(stem, "left_right")), ("east_west", has(text, "east_west")), ("rotation_sense", has(text, "rotation_sense"))])
    order = _reasons([("order_question", space == "order"), ("motion", F.col("op_camera_motion") | F.col("op_object_motion")), ("temporal_reference", has(stem, "temporal_ref") | _any(opts, "temporal_ref"))])
    swap, ordinal = _any(opts, "left_right"), has(stem, "image_ordinal") | _any(opts, "image_ordinal")
    sequence, shuffled = has(stem, "image_sequence"), has(stem, "shuffled")
    q = q.withColumns({"__unsafe": unsafe, "__rewrite": rewrite, "__order": order, "__anchor": F.when(anchor == "last", F.col("n_images")).otherwise(anchor.cast("int"))})
    turned = space.isin("ego_direction", "compass", "angle", "route")
    out = {
        "anchor_image": F.col("__anchor"),
        "anchor_is_first": F.col("__anchor") == 1,
        "img_index": has(stem, "image_index"),
        "img_ordinal": has(stem, "image_ordinal"),
        "img_sequence": sequence,
        "img_none": ~(has(stem, "image_index") | has(stem, "image_ordinal") | sequence),
        "cap_overlap": has(stem, "overlap"),
        "cap_same_place": has(stem, "same_place"),
        "cap_first_person": has(stem, "first_person"),
        "cap_rig": has(stem, "rig"),
        "hedge": has(stem, "hedge"),
        "abstain_option": _any(opts, "abstain"),
        "lr_in_stem": has(stem, "left_right"),
        "lr_in_options": swap,
        "fb_in_options": _any(opts, "front_back"),
        "ud_in_options": _any(opts, "up_down"),
        "op_direction": turned | (space.isin("entity", "statement") & has(stem, "direction_query")),
        "op_metric": space == "metric",
        "op_count": (space == "count") | has(stem, "count_stem"),
        "op_perspective_taking": F.col("f_agent") | F.col("f_front_by_object"),
        "op_absolute_frame": F.col("f_axes") | F.col("f_compass_stem") | F.col("f_compass_options"),
        "op_cross_view_explicit": has(stem, "cross_view") | (F.size(F.array_distinct("refs")) >= 2),
        "op_premise_chain": F.col("has_premise") & (turned | (space == "statement")),
        "op_temporal_order": space == "order",
        "op_route": space == "route",
        "op_statement_check": space == "statement",
        "mirror_level": F.when(F.col("__unsafe") != "", "unsafe").when(F.col("__rewrite") != "", "rewrite_stem").when(swap, "swap_options").otherwise("no_change"),
        "mirror_reasons": F.when(F.col("__unsafe") != "", F.col("__unsafe")).when(F.col("__rewrite") != "", F.col("__rewrite")).when(swap, "left_right_in_options").otherwise(""),
        "reorder_level": F.when(shuffled, "safe").when(F.col("__order") != "", "unsafe").when(ordinal | sequence, "label_dependent").otherwise("safe"),
        "reorder_reasons": F.when(shuffled, "order_declared_shuffled").when(F.col("__order") != "", F.col("__order")).when(ordinal, "ordinal_image_reference").when(sequence, "sequence_stated").otherwise(""),
    }
    kept = "id answer_space frame f_axes f_compass_stem f_compass_options f_agent f_camera_self f_front_by_camera f_front_by_object f_object_ref n_declarative n_parenthetical has_premise op_camera_motion op_object_motion".split()
    return q.select(*kept, *[c.alias(n) for n, c in out.items()])

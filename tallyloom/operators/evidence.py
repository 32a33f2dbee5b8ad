"""Evidence inventories (schema ws-1): parsing, first violated rule, repair and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import json_schema

_CROSS = "struct<status:string,uncertainty:string>"
SCHEMA = (
    "schema_version string, query_frame struct<frame:string,basis:string>, temporal_order struct<status:string,order:array<string>,basis:string>, "
    "cameras array<struct<id:string,image_id:string>>, "
    f"entities array<struct<id:string,type:string,label:string,cross_view:{_CROSS}>>, "
    "observations array<struct<id:string,entity:string,image_id:string,`where`:string,description:string>>, "
    "identity_links array<struct<id:string,entities:array<string>,status:string,uncertainty:string>>, "
    "claims array<struct<id:string,kind:string,subject:string,predicate:string,object:string,value:string,frame:string,image_id:string,support:array<string>,uncertainty:string,note:string>>, "
    "unknowns array<string>"
)
#: Enumerations, id patterns and limits of the schema.
ENUMS = {
    "type": "object region".split(),
    "where": "left center right top bottom top_left top_right bottom_left bottom_right unknown".split(),
    "uncertainty": "low medium high".split(),
    "link": "tentative different".split(),
    "kind": "relation attribute".split(),
    "relation": (
        "left_of right_of in_front_of behind above below on inside near far_from adjacent_to facing camera_rotated_left camera_rotated_right "
        "camera_moved_forward camera_moved_backward camera_moved_left camera_moved_right camera_moved_up camera_moved_down moved_left moved_right "
        "moved_toward moved_away_from moved_up moved_down other"
    ).split(),
    "attribute": "color shape material size count length height distance text state other".split(),
}
RULES = "format json not_object schema camera_count camera_mapping duplicate_id image_range unresolved_ref cross_view image_id motion_endpoints note temporal_order".split()


def _schema() -> dict:
    """The JSON Schema of an inventory, from its fixed values: limits, patterns, enumerations, and what excludes what."""
    ident = lambda prefix: {"type": "string", "pattern": rf"^{prefix}[1-9]\d*$"}
    one_of = lambda name: {"type": "string", "enum": ENUMS[name]}
    up_to = lambda n, *more: {"type": ["string", *more], "maxLength": n}
    maybe = lambda x: {"anyOf": [{"type": "null"}, x]}
    record = lambda **fields: {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}
    many = lambda n, x: {"type": "array", "items": x} | ({"maxItems": n} if n else {})
    given = lambda field, test, **then: {"if": {"properties": {field: test}, "required": [field]}, "then": {"properties": then}}
    null, image, entity, seen = {"type": "null"}, ident("image_"), ident("e"), ident("o")
    node = {"type": "string", "pattern": r"^(?:e[1-9]\d*|cam[1-9]\d*)$"}
    frame = {"type": "string", "pattern": r"^(?:image_plane:image_[1-9]\d*|camera:cam[1-9]\d*|entity:e[1-9]\d*|unknown)$"}
    images = {"type": "array", "minItems": 1, "uniqueItems": True, "items": image}
    order = record(status={"type": "string", "enum": ["supported", "unknown"]}, order=maybe(images), basis=up_to(160, "null"))
    order["allOf"] = [given("status", {"const": "unknown"}, order=null, basis=null), given("status", {"const": "supported"}, order=images, basis=up_to(160))]
    claim = record(
        id=ident("c"), kind=one_of("kind"), subject=node, predicate={"type": "string"}, object=maybe(node), value=maybe(up_to(60)), frame=frame, image_id=maybe(image),
        support={"type": "array", "minItems": 1, "items": seen}, uncertainty=one_of("uncertainty"), note=up_to(120, "null"),
    )
    claim["allOf"] = [given("kind", {"const": "relation"}, predicate=one_of("relation"), object=node, value=null), given("kind", {"const": "attribute"}, predicate=one_of("attribute"), object=null, value=up_to(60)), given("frame", {"pattern": "^image_plane:"}, image_id=image)]
    claim["allOf"][2]["then"]["required"] = ["image_id"]
    cross = record(status={"type": "string", "enum": ["same"]}, uncertainty=one_of("uncertainty"))
    return record(
        schema_version={"const": "ws-1"},
        query_frame=record(frame=frame, basis=up_to(160, "null")),
        temporal_order=order,
        cameras=many(None, record(id=ident("cam"), image_id=image)),
        entities=many(8, record(id=entity, type=one_of("type"), label=up_to(60), cross_view=maybe(cross))),
        observations=many(32, record(id=seen, entity=node, image_id=image, where=one_of("where"), description=up_to(120))),
        identity_links=many(8, record(id=ident("i"), entities={"type": "array", "minItems": 2, "maxItems": 2, "uniqueItems": True, "items": entity}, status=one_of("link"), uncertainty=one_of("uncertainty"))),
        claims=many(24, claim),
        unknowns=many(8, up_to(200)),
    )


JSON_SCHEMA = _schema()
_STRIP = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A{_STRIP}", ""), rf"{_STRIP}\z", "")


def body(text: Column) -> Column:
    """What may be JSON in a response: the whole text, or what one fence around it holds; null with anything else around."""
    t = F.regexp_replace(_stripped(text), r"\A\ufeff+", "")
    inner = F.regexp_extract(t, r"(?s)\A```[^\n`]*\n(.*?)\n?```\z", 1)
    fenced = F.when(t.rlike(r"(?s)\A```[^\n`]*\n.*```\z") & ~inner.rlike(r"(?m)^```"), _stripped(inner))
    bare = F.when(t.rlike(r"\A[{\[\"\-\p{Nd}]") | t.isin("null", "true", "false"), t)
    return F.when(t.startswith("```"), fenced).otherwise(bare)


def parsed(df: DataFrame, text: str = "text", out: str = "inv") -> DataFrame:
    """``df`` with the inventory as a struct, null where the text is no JSON object, and ``{out}_error``: the rule that
    the text or the schema breaks (format, json, not_object, schema), with path and keyword for the schema.

    A value with more text after it breaks ``format``. The parser reads a value and leaves what follows, so a whole
    text is one that still is a value inside brackets, and inside braces.
    """
    doc = df.withColumn("__body", body(F.col(text)))
    doc = doc.withColumn("__v", F.try_parse_json("__body"))
    one = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("__body"), F.lit("]"))), "$", "array<variant>")) == 1
    own = F.map_keys(F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"k":'), F.col("__body"), F.lit("}"))), "$", "map<string,variant>"))
    whole = F.coalesce(one & (F.size(own) == 1) & (F.get(own, F.lit(0)) == "k"), F.lit(False))
    token = F.when(F.col("__body").isNull(), "format").when(F.col("__v").isNull(), "json").when(~whole, "format").when(json_schema.kind(F.col("__v")) != "object", "not_object")
    # A generator keeps the optimizer from computing the checks again wherever they are used.
    checked = doc.select("*", F.explode(F.array(F.struct(token.alias("token"), json_schema.first_violation(JSON_SCHEMA, F.col("__v")).alias("first")))).alias("__c"))
    rule = F.coalesce("__c.token", F.when(F.col("__c.first").isNotNull(), "schema"))
    error = F.when(rule.isNotNull(), F.struct(rule.alias("rule"), F.when(rule == "schema", F.col("__c.first.path")).alias("path"), F.when(rule == "schema", F.col("__c.first.keyword")).alias("keyword")))
    made = F.when(F.col("__c.token").isNull(), F.from_json("__body", SCHEMA, {"mode": "PERMISSIVE"}))
    # So does this one: pushed into a filter, the text would be parsed once for each test.
    kept = [c for c in checked.columns if c != out]
    return checked.select(*kept, F.explode(F.array(made)).alias(out)).withColumn(f"{out}_error", error).drop("__body", "__v", "__c")


def _images_of(entity: Column) -> Column:
    seen = F.filter(F.col("inv.observations"), lambda o: o["entity"] == entity)
    return F.size(F.array_distinct(F.transform(seen, lambda o: o["image_id"])))


def first_error(n_images: str = "n_images") -> Column:
    """The first rule, in their fixed order, that the inventory breaks; null if none. Needs the columns of ``parsed``."""
    n = F.col(n_images)
    cams, ents, obs, links, claims = (F.col(f"inv.{x}") for x in ("cameras", "entities", "observations", "identity_links", "claims"))
    allowed = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("image_"), i))
    ent_ids, cam_ids, obs_ids = (F.transform(x, lambda y: y["id"]) for x in (ents, cams, obs))
    nodes = F.concat(ent_ids, cam_ids)
    known = lambda ids, x: F.array_contains(ids, x)
    twice = F.lit(False)
    for x in (cams, ents, obs, links, claims):
        ids = F.transform(x, lambda y: y["id"])
        twice |= F.size(F.array_distinct(ids)) < F.size(ids)
    target = lambda f: F.split_part(f, F.lit(":"), F.lit(2))
    frame_bad = lambda f: F.when(f.startswith("image_plane:"), ~known(allowed, target(f))).when(f.startswith("camera:"), ~known(cam_ids, target(f))).when(f.startswith("entity:"), ~known(ent_ids, target(f))).otherwise(False)
    unresolved = (
        F.exists(obs, lambda o: ~known(nodes, o["entity"]))
        | F.exists(links, lambda k: F.exists(k["entities"], lambda e: ~known(ent_ids, e)))
        | F.exists(claims, lambda c: ~known(nodes, c["subject"]) | ((c["kind"] == "relation") & ~known(nodes, c["object"])) | F.exists(c["support"], lambda s: ~known(obs_ids, s)) | frame_bad(c["frame"]))
        | frame_bad(F.col("inv.query_frame.frame"))
    )
    order = F.col("inv.temporal_order.order")
    moves = lambda c: c["predicate"].startswith("camera_")
    tests = [
        ("camera_count", F.size(cams) != n),
        ("camera_mapping", F.exists(F.transform(cams, lambda c, i: (c["id"] != F.concat(F.lit("cam"), i + 1)) | (c["image_id"] != F.concat(F.lit("image_"), i + 1))), lambda x: x)),
        ("duplicate_id", twice),
        ("image_range", F.exists(obs, lambda o: ~known(allowed, o["image_id"])) | F.exists(claims, lambda c: c["image_id"].isNotNull() & ~known(allowed, c["image_id"]))),
        ("unresolved_ref", unresolved),
        ("cross_view", F.exists(ents, lambda e: e["cross_view"].isNotNull() & (_images_of(e["id"]) < 2))),
        ("image_id", F.exists(claims, lambda c: c["frame"].startswith("image_plane:") & (c["image_id"] != target(c["frame"])))),
        ("motion_endpoints", F.exists(claims, lambda c: moves(c) & ~(c["subject"].startswith("cam") & c["object"].startswith("cam")))),
        ("note", F.exists(claims, lambda c: (c["predicate"] == "other") & c["note"].isNull())),
        ("temporal_order", (F.col("inv.temporal_order.status") == "supported") & (F.array_sort(order) != F.array_sort(allowed))),
    ]
    return F.coalesce(F.col("inv_error.rule"), *[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in tests])


def repaired() -> Column:
    """Entities seen in two or more images, but without cross_view, with the assertion that their id makes."""
    same = F.struct(F.lit("same").alias("status"), F.lit("medium").alias("uncertainty"))
    return F.transform(F.col("inv.entities"), lambda e: F.when(e["cross_view"].isNull() & (_images_of(e["id"]) >= 2), e.withField("cross_view", same)).otherwise(e))


def coverage(df: DataFrame) -> DataFrame:
    """Counts and flags of each inventory; a missing one has nulls, not zeros."""
    size = lambda x: F.when(F.col("inv").isNotNull(), F.size(F.col(f"inv.{x}")).cast("long"))
    return df.select(
        "id",
        *[size(x).alias(f"n_{x}") for x in ("entities", "observations", "identity_links", "claims", "unknowns")],
        F.exists(F.col("inv.entities"), lambda e: e["cross_view"].isNotNull()).alias("has_cross_view"),
        (F.col("inv.temporal_order.status") == "supported").alias("has_order"),
    )

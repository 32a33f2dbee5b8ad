"""Sampling, graphs, evidence documents, state and windows over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.rng import u32
from tallyloom.operators import evidence, graph, nested, renderings, sampling, state
from tallyloom.operators.evidence import ENUMS
from tallyloom.operators.similarity import threshold_pairs
from tallyloom.plans.registry import EV, U, events, query, r6
from tallyloom.sources.readers import table
from tallyloom.sources.staging import staged
from tallyloom.streaming import windows as stream


@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id), doc_id) % 2 = 1 THEN 'explore' ELSE 'confirm' END AS split FROM documents")
def stratified_split(spark, sf):
    return sampling.split_half(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0)


@query("SELECT doc_id, lang, difficulty, rank, substr('AB', rank::INT, 1) AS set FROM (SELECT doc_id, lang, n_chars % 2 AS difficulty, row_number() OVER (PARTITION BY lang, n_chars % 2 ORDER BY md5('5|' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 2")
def two_per_cell_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") % 2).alias("difficulty"))
    return sampling.per_cell(d, ["lang", "difficulty"], "doc_id", 2, 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('9|' || doc_id), doc_id) AS rank FROM documents) ORDER BY rank, source LIMIT 50")
def round_robin_sample(spark, sf):
    return sampling.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 50, 9).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query()
def group_exclusive_sample(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.md5("text").alias("t")).agg(F.min("doc_id").alias("group"), F.min_by("doc_id", "doc_id").alias("id"), F.min("lang").alias("category"))
    return sampling.group_exclusive(d.select("id", "category", "group"), 60, 1)


SIM = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_E = f"e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {SIM} >= 0.4)"
_CC = f"WITH RECURSIVE {_E}, r AS (SELECT DISTINCT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen), c AS (SELECT node, min(seen) AS label FROM r GROUP BY 1)"


def _links(spark, sf, threshold=0.4):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return threshold_pairs(v, threshold).select(F.col("a").alias("u"), F.col("b").alias("v"), "sim")


@query(f"{_CC} SELECT node, label FROM c")
def connected_components(spark, sf):
    return graph.components(_links(spark, sf))


@query(f"{_CC} SELECT c.label AS component, count(*) AS size, count(DISTINCT e.label) AS n_categories, min(e.label)::INT AS first_category FROM c JOIN embeddings e ON e.vec_id = c.node GROUP BY 1")
def component_table(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("category"))
    return graph.components(_links(spark, sf)).join(e, "node").groupBy(F.col("label").alias("component")).agg(F.count(F.lit(1)).alias("size"), F.countDistinct("category").alias("n_categories"), F.min("category").alias("first_category"))


@query(f"WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {SIM} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), t AS (SELECT unnest([0.3, 0.4, 0.45])::DOUBLE AS threshold) SELECT t.threshold, count(DISTINCT x) AS n_ids FROM t JOIN (SELECT a AS x, s FROM p UNION ALL SELECT b, s FROM p) q ON q.s >= t.threshold GROUP BY 1")
def threshold_sensitivity(spark, sf):
    p = _links(spark, sf, 0.3)
    t = p.select(F.explode(F.array("u", "v")).alias("x"), "sim").withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.3, 0.4, 0.45)])))
    return t.where("sim >= threshold").groupBy("threshold").agg(F.countDistinct("x").alias("n_ids"))


@query("WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS g FROM documents) SELECT doc_id, g AS group_id FROM g")
def shared_content_groups(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("t"))
    return d.join(d.groupBy("t").agg(F.min("doc_id").alias("group_id")), "t").select("doc_id", "group_id")


def _doc(**change) -> dict:
    """A kitchen seen by three cameras: a kettle that two of them show, and a window bay."""
    base = {
        "schema_version": "ws-1", "query_frame": {"frame": "camera:cam3", "basis": "asked from the stove"}, "temporal_order": {"status": "unknown", "order": None, "basis": None},
        "cameras": [{"id": f"cam{k}", "image_id": f"image_{k}"} for k in (1, 2, 3)],
        "entities": [{"id": "e4", "type": "object", "label": "steel kettle", "cross_view": {"status": "same", "uncertainty": "low"}}, {"id": "e7", "type": "region", "label": "window bay", "cross_view": None}],
        "observations": [
            {"id": "o2", "entity": "e4", "image_id": "image_2", "where": "right", "description": "kettle on the stove"}, {"id": "o5", "entity": "e4", "image_id": "image_3", "where": "bottom_left", "description": "its spout"},
            {"id": "o6", "entity": "e7", "image_id": "image_2", "where": "top", "description": "bay with plants"},
        ],
        "identity_links": [],
        "claims": [{"id": "c3", "kind": "relation", "subject": "e7", "predicate": "above", "object": "e4", "value": None, "frame": "image_plane:image_2", "image_id": "image_2", "support": ["o2", "o6"], "uncertainty": "high", "note": None}],
        "unknowns": ["whether the stove is on"],
    }
    return base | change


def _claim(**change) -> list[dict]:
    return [_doc()["claims"][0] | change]


#: (id, text, images, first rule that is broken).
def inventories() -> list[tuple[int, str, int, str | None]]:
    import json

    d = _doc()
    kettle, bay = d["entities"]
    cases = [
        (d, None), (_doc(cameras=d["cameras"][:2]), "camera_count"), (_doc(cameras=d["cameras"][::-1]), "camera_mapping"), (_doc(entities=[kettle, kettle]), "duplicate_id"),
        (_doc(claims=_claim(image_id="image_8", frame="unknown")), "image_range"), (_doc(claims=_claim(subject="e9")), "unresolved_ref"), (_doc(entities=[kettle, bay | {"cross_view": {"status": "same", "uncertainty": "high"}}]), "cross_view"),
        (_doc(claims=_claim(image_id="image_3")), "image_id"), (_doc(claims=_claim(predicate="camera_moved_up")), "motion_endpoints"), (_doc(claims=_claim(predicate="other")), "note"),
        (_doc(temporal_order={"status": "supported", "order": ["image_2", "image_1"], "basis": "shadows"}), "temporal_order"), (_doc(schema_version="ws-0"), "schema"), (_doc(entities=[kettle | {"cross_view": None}, bay]), None),
    ]
    out = [(i, json.dumps(x), 3, rule) for i, (x, rule) in enumerate(cases, 1)]
    n = len(out)
    return [*out, (n + 1, "```json\n" + json.dumps(d) + "\n```", 3, None), (n + 2, json.dumps(d)[:-9], 3, "json"), (n + 3, "See: " + json.dumps(d), 3, "format")]


_INV = inventories()
_DEALT = f"({U("'inv|' || doc_id")} % {len(_INV)} + 1)"


def _frame(spark, sf):
    """An inventory for every document: one of the cases, dealt by a hash."""
    cases = F.array(*[F.lit(x[1]) for x in _INV])
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.element_at(cases, (u32("inv", F.col("doc_id")) % len(_INV) + 1).cast("int")).alias("text"), F.lit(3).alias("n_images"))
    return evidence.parsed(d)


def _good(spark, sf):
    return _frame(spark, sf).where(evidence.first_error().isNull())


@query("SELECT doc_id AS id, rule FROM documents JOIN (VALUES " + ", ".join(f"({i}, {'NULL' if r is None else repr(r)})" for i, _, _, r in _INV) + f") t(k, rule) ON k = {_DEALT}")
def inventory_rules_first_error(spark, sf):
    return _frame(spark, sf).select("id", evidence.first_error().alias("rule"))


_WELL = "d AS (SELECT doc_id AS id, j::JSON AS j FROM documents JOIN (VALUES " + ", ".join("({}, '{}')".format(i, t.removeprefix("```json").removesuffix("```").replace("'", "''")) for i, t, _, r in _INV if r is None) + f") v(k, j) ON k = {_DEALT})"


@query(f"""WITH {_WELL} SELECT id, json_array_length(j->'entities')::BIGINT AS n_entities, json_array_length(j->'observations')::BIGINT AS n_observations, json_array_length(j->'identity_links')::BIGINT AS n_identity_links, json_array_length(j->'claims')::BIGINT AS n_claims, json_array_length(j->'unknowns')::BIGINT AS n_unknowns,
len(list_filter(json_extract_string(j, '$.entities[*].cross_view.status'), lambda x: x IS NOT NULL)) > 0 AS has_cross_view, (j->'temporal_order'->>'status') = 'supported' AS has_order FROM d""")
def coverage_from_json(spark, sf):
    return evidence.coverage(_good(spark, sf))


_J = "json_extract_string({0}, '$.{1}')"


def _atom_sql() -> str:
    """The sentences of all eight kinds from the JSON of the inventories."""
    g = lambda x, k: f"({x}->>'{k}')"
    q = lambda x: f"to_json({x})::VARCHAR"
    each = lambda name, kind, text: f"SELECT id, '{kind}' AS kind, x->>'id' AS atom_id, {text} AS text FROM (SELECT id, unnest(json_extract(j, '$.{name}[*]')) AS x FROM d)"
    basis = "coalesce(' (basis: ' || json_extract_string(j, '$.{0}.basis') || ')', '')"
    claim = (
        f"CASE WHEN {g('x', 'image_id')} IS NOT NULL THEN 'In frame ' || {g('x', 'frame')} || ', for ' || {g('x', 'image_id')} || ', ' WHEN {g('x', 'frame')} = 'unknown' THEN 'Across views, ' ELSE 'Across views, in frame ' || {g('x', 'frame')} || ', ' END"
        f" || CASE WHEN {g('x', 'kind')} = 'relation' THEN {g('x', 'subject')} || ' is ' || {g('x', 'predicate')} || ' ' || {g('x', 'object')} ELSE 'attribute ' || {g('x', 'predicate')} || ' of ' || {g('x', 'subject')} || ' is ' || {q(g('x', 'value'))} END"
        f" || '. Support: ' || array_to_string((x->'support')::VARCHAR[], ', ') || '. Uncertainty: ' || {g('x', 'uncertainty')} || '.' || coalesce(' Note: ' || {q(g('x', 'note'))} || '.', '')"
    )
    return " UNION ALL ".join([
        f"SELECT id, 'query_frame' AS kind, 'query_frame' AS atom_id, 'Query frame: ' || json_extract_string(j, '$.query_frame.frame') || {basis.format('query_frame')} || '.' AS text FROM d",
        f"SELECT id, 'temporal_order', 'temporal_order', 'Temporal order: ' || coalesce(array_to_string(nullif(json_extract(j, '$.temporal_order.order'), 'null'::JSON)::VARCHAR[], ', '), 'unknown') || {basis.format('temporal_order')} || '.' FROM d",
        each("cameras", "camera", f"'Camera ' || {g('x', 'id')} || ' took ' || {g('x', 'image_id')} || '.'"),
        each("entities", "entity", f"{g('x', 'id')} || CASE WHEN {g('x', 'type')} = 'object' THEN ' is an object' ELSE ' is a ' || {g('x', 'type')} END || ' labeled ' || {q(g('x', 'label'))} || coalesce('; it is the same entity across views (uncertainty ' || json_extract_string(x, '$.cross_view.uncertainty') || ')', '') || '.'"),
        each("observations", "observation", f"'In ' || {g('x', 'image_id')} || ' (' || {g('x', 'where')} || '), ' || {g('x', 'entity')} || ' is observed: ' || {q(g('x', 'description'))} || '.'"),
        each("identity_links", "identity_link", f"'Identity link between ' || json_extract_string(x, '$.entities[0]') || ' and ' || json_extract_string(x, '$.entities[1]') || ' is ' || {g('x', 'status')} || ' (uncertainty ' || {g('x', 'uncertainty')} || ').'"),
        each("claims", "claim", claim),
        "SELECT id, 'unknown', 'u' || k, 'Unknown: ' || (u->>'$') || '.' FROM (SELECT id, unnest(json_extract(j, '$.unknowns[*]')) AS u, generate_subscripts(json_extract(j, '$.unknowns[*]'), 1) AS k FROM d)",
    ])


def _facts(df):
    return renderings.with_facts(df).select("id", "facts")


@query(f"WITH {_WELL} {_atom_sql()}")
def inventory_atoms(spark, sf):
    f = _facts(_good(spark, sf)).select("id", F.explode("facts").alias("f"))
    return f.select("id", "f.kind", "f.atom_id", renderings.sentence(F.col("f")).alias("text"))


@query()
def flat_render(spark, sf):
    return renderings.round_trips(_facts(_good(spark, sf))).select("id", "flat", "graph")


#: Texts that a rendering has to quote, or that look like its own marks.
HOSTILE = ["", '"', "\\", ")", " | ", "\n", "\t", '. Note: "x".', " Support: o1. ", "\x01", "; it is the same entity across views (uncertainty low).", "\u2028", "{}", ": none", "  ", "Unknowns:"]


def drawn_inventories(spark, sf):
    """An inventory made from each document's own text and hashes of its id: (id, text, n_images). Labels and notes begin
    with hostile pieces and go on with pieces of the document."""
    i = F.col("doc_id")
    h = lambda n, *parts: u32(*parts, i) % n
    pick = lambda xs, *parts: F.element_at(F.array(*map(F.lit, xs)), (h(len(xs), *parts) + 1).cast("int"))
    piece = lambda limit, *parts: F.substring(F.concat(pick(HOSTILE, "mark", *parts), F.substring("t", (h(1_000_000, "at", *parts) % F.greatest(F.length("t"), F.lit(1)) + 1).cast("int"), F.lit(limit // 2)), pick(HOSTILE, "end", *parts)), 1, limit)
    level = lambda *parts: pick(ENUMS["uncertainty"], "level", *parts)
    null = F.lit(None).cast("string")
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), (2 + u32("images", i) % 2).cast("int").alias("n_images"), (1 + u32("entities", i) % 4).cast("int").alias("n"))
    count = lambda e: (1 + h(1_000, "seen", e) % F.col("n_images")).cast("int")
    named = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    each = F.sequence(F.lit(1), F.col("n"))
    entity = lambda e: F.struct(named("e", e).alias("id"), F.when(e == 1, "object").otherwise(pick(ENUMS["type"], "type", e)).alias("type"), piece(60, "label", e).alias("label"), F.when(count(e) > 1, F.struct(F.lit("same").alias("status"), level("cross", e).alias("uncertainty"))).alias("cross_view"))
    seen = lambda e: F.transform(F.sequence(F.lit(1), count(e)), lambda k: F.struct(named("o", (e - 1) * 3 + k).alias("id"), named("e", e).alias("entity"), named("image_", k).alias("image_id"), pick(ENUMS["where"], "where", e, k).alias("where"), piece(120, "seen", e, k).alias("description")))

    def claim(e):
        relation = (h(2, "kind", e) == 0) & (F.col("n") > 1)
        frame = pick(["unknown", "image_plane:image_1", "camera:cam1", "entity:e1"], "frame", e)
        return F.struct(
            named("c", e).alias("id"), F.when(relation, "relation").otherwise("attribute").alias("kind"), named("e", e).alias("subject"), F.when(relation, pick(["left_of", "behind", "near", "on"], "rel", e)).otherwise(pick(["color", "state", "text"], "attr", e)).alias("predicate"),
            F.when(relation, named("e", e % F.col("n") + 1)).alias("object"), F.when(~relation, piece(60, "value", e)).alias("value"), frame.alias("frame"), F.when(frame.startswith("image_plane"), "image_1").otherwise(null).alias("image_id"),
            F.array(named("o", (e - 1) * 3 + 1)).alias("support"), level("claim", e).alias("uncertainty"), F.when(h(3, "noted", e) == 0, piece(120, "note", e)).alias("note"),
        )

    ordered = h(2, "ordered") == 0
    images = F.transform(F.sequence(F.lit(1), F.col("n_images")), lambda k: named("image_", k))
    doc = F.struct(
        F.lit("ws-1").alias("schema_version"),
        F.struct(pick(["unknown", "camera:cam1", "entity:e1"], "asked").alias("frame"), F.when(h(2, "based") == 0, piece(160, "basis")).alias("basis")).alias("query_frame"),
        F.struct(F.when(ordered, "supported").otherwise("unknown").alias("status"), F.when(ordered, images).alias("order"), F.when(ordered, piece(160, "time")).alias("basis")).alias("temporal_order"),
        F.transform(F.sequence(F.lit(1), F.col("n_images")), lambda k: F.struct(named("cam", k).alias("id"), named("image_", k).alias("image_id"))).alias("cameras"),
        F.transform(each, entity).alias("entities"),
        F.flatten(F.transform(each, seen)).alias("observations"),
        F.when((F.col("n") > 1) & (h(2, "linked") == 0), F.array(F.struct(F.lit("i1").alias("id"), F.array(F.lit("e1"), F.lit("e2")).alias("entities"), pick(ENUMS["link"], "link").alias("status"), level("link").alias("uncertainty")))).otherwise(F.array()).alias("identity_links"),
        F.transform(each, claim).alias("claims"),
        F.transform(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), h(3, "unknowns").cast("int")), lambda k: piece(200, "unknown", k)).alias("unknowns"),
    )
    # Stored: what reads the text would write out its making wherever it stands.
    return staged(d.select(i.alias("id"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("text"), "n_images"), "inventories")


@query()
def inventory_renderings(spark, sf):
    """Both renderings of an inventory drawn from every document, and what reading them back loses or makes up."""
    df = evidence.parsed(drawn_inventories(spark, sf)).where(evidence.first_error().isNull())
    r = renderings.round_trips(_facts(df))
    return r.select("id", F.size("facts").cast("long").alias("n_facts"), "flat_lost", "flat_extra", "graph_lost", "graph_extra", F.sha2("flat", 256).alias("flat_sha256"), F.sha2("graph", 256).alias("graph_sha256"))


#: What is changed in an inventory, and the first error that follows: (from, to, rule, path, keyword).
DAMAGE = [
    ("", "", None, None, None), ('"schema_version":"ws-1"', '"schema_version":"ws-0"', "schema", "schema_version", "const"), ('"id":"e1","type":"object"', '"id":"e1","type":"thing"', "schema", "entities/0/type", "enum"),
    ('"id":"cam1"', '"id":"cam01"', "schema", "cameras/0/id", "pattern"), ('"unknowns":[', '"unknowns":[7', "schema", "unknowns/0", "type"), ('{"schema_version"', '{"extra":1,"schema_version"', "schema", "(root)", "additionalProperties"),
    ('"cameras":', '"cams":', "schema", "(root)", "additionalProperties"), ('"id":"o1","entity":"e1"', '"id":"o1","entity":null', "schema", "observations/0/entity", "type"), ('{"schema_version"', 'Answer: {"schema_version"', "format", None, None),
    ('{"schema_version":', '{"schema_version"', "json", None, None), ('{"schema_version"', '[{"schema_version"', "not_object", None, None), ('"support":["o1"]', '"support":[]', "schema", "claims/0/support", "minItems"),
    ('{"schema_version"', '\ufeff{"schema_version"', None, None, None), ('"schema_version":"ws-1",', "", "schema", "(root)", "required"),
]


@query("SELECT doc_id AS id, rule, path, keyword FROM documents JOIN (VALUES " + ", ".join("(" + ", ".join([str(k), *["NULL" if x is None else f"'{x}'" for x in row[2:]]]) + ")" for k, row in enumerate(DAMAGE)) + f") t(k, rule, path, keyword) ON k = {U("'damage|' || doc_id")} % {len(DAMAGE)}")
def inventory_schema_errors(spark, sf):
    """The first error of drawn inventories after damage, with path and keyword where the schema is broken."""
    d = drawn_inventories(spark, sf)
    k = u32("damage", F.col("id")) % len(DAMAGE)
    text = F.col("text")
    for n, (old, new, rule, _, _) in enumerate(DAMAGE):
        if old:
            fixed = F.replace("text", F.lit(old), F.lit(new))
            fixed = F.concat(fixed, F.lit("]")) if rule == "not_object" else F.regexp_replace(fixed, r'"unknowns":\[7(?!\])', '"unknowns":[7,') if "[7" in new else fixed
            text = F.when(k == n, fixed) if n == 1 else text.when(k == n, fixed)
    out = evidence.parsed(staged(d.withColumn("text", text.otherwise(F.col("text"))), "damaged"))
    return out.select("id", evidence.first_error().alias("rule"), "inv_error.path", "inv_error.keyword")


_CUR = "cur AS (SELECT user_id AS reviewer, user_id % 10 AS item, min(value) AS seconds, min(event_type) AS answer, min(event_id) AS created FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2), inc AS (SELECT user_id AS reviewer, user_id % 10 AS item, max(value) AS seconds, max(event_type) AS answer, max(event_id) AS created FROM events WHERE event_type <> 'click' GROUP BY 1, 2)"


def _reviews(spark, sf):
    e = table(spark, sf, "events")
    cur = e.where("event_type IN ('click', 'view')").groupBy(F.col("user_id").alias("reviewer"), (F.col("user_id") % 10).alias("item")).agg(F.min("value").alias("seconds"), F.min("event_type").alias("answer"), F.min("event_id").alias("created"))
    inc = e.where("event_type <> 'click'").groupBy(F.col("user_id").alias("reviewer"), (F.col("user_id") % 10).alias("item")).agg(F.max("value").alias("seconds"), F.max("event_type").alias("answer"), F.max("event_id").alias("created"))
    return cur, inc


@query(f"""WITH {_CUR} SELECT coalesce(i.reviewer, c.reviewer) AS reviewer, coalesce(i.item, c.item) AS item, round(coalesce(c.seconds, 0) + coalesce(i.seconds, 0), 6) AS seconds, CASE WHEN i.item IS NOT NULL THEN i.answer ELSE c.answer END AS answer, coalesce(c.created, i.created) AS created
FROM cur c FULL JOIN inc i ON i.reviewer = c.reviewer AND i.item = c.item""")
def upsert_accumulate(spark, sf):
    cur, inc = _reviews(spark, sf)
    return state.upsert_accumulate(cur, inc, ["reviewer", "item"], "seconds", "created").withColumn("seconds", r6("seconds"))


@query(f"WITH {_CUR} SELECT * FROM cur UNION ALL SELECT * FROM inc i WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.reviewer = i.reviewer AND c.item = i.item)")
def insert_or_ignore(spark, sf):
    cur, inc = _reviews(spark, sf)
    return state.insert_new(cur, inc, ["reviewer", "item"])


@query(f"WITH {_CUR} SELECT c.reviewer, c.item FROM cur c JOIN inc i ON i.reviewer = c.reviewer AND i.item = c.item WHERE (c.seconds, c.answer, c.created) IS DISTINCT FROM (i.seconds, i.answer, i.created)")
def import_conflicts(spark, sf):
    cur, inc = _reviews(spark, sf)
    return state.conflicts(cur, inc, ["reviewer", "item"])


@query(f"WITH {EV} SELECT s.id, s.condition FROM (SELECT DISTINCT id, condition FROM ev) s WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.id = s.id AND e.condition = s.condition AND e.status = 'ok' AND e.latency > 60)")
def pending_anti_join(spark, sf):
    e = events(spark, sf)
    return state.pending(e.select("id", "condition").distinct(), e.where("status = 'ok' AND latency > 60"), ["id", "condition"])


@query(f"""WITH a AS (SELECT doc_id, 'R' || (1 + {U("'rev|' || doc_id")} % 4) AS reviewer FROM documents), b AS (SELECT * FROM a WHERE {U("'done|' || doc_id")} % 50 > 0)
SELECT a.reviewer, count(*) AS assigned, count(b.doc_id) AS answered, count(*) = count(b.doc_id) AS unlocked FROM a LEFT JOIN b ON b.doc_id = a.doc_id GROUP BY 1""")
def trace_gate(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("R"), 1 + u32("rev", F.col("doc_id")) % 4).alias("reviewer"))
    return state.unlocked(a, a.where(u32("done", F.col("doc_id")) % 50 > 0), "reviewer", "doc_id")


CONFIG = [("model.name", "m1", "m2"), ("model.rev", "a", "a"), ("seed", "0", None), ("n", None, "5")]


@query("SELECT * FROM (VALUES ('model.name', 'm1', 'm2'), ('seed', '0', NULL), ('n', NULL, '5')) t(path, before, after)")
def config_diff(spark, sf):
    a = spark.createDataFrame([(p, x) for p, x, _ in CONFIG if x is not None], "path string, value string")
    b = spark.createDataFrame([(p, y) for p, _, y in CONFIG if y is not None], "path string, value string")
    return state.changed_paths(a, b)


_VERSIONS = """v AS (SELECT event_id, user_id, '{"props":' || props || ',"run":{"type":"' || event_type || '","steps":' || CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[1,{"a":null}]' WHEN 2 THEN '"none"' ELSE '[1,{"a":' || user_id || '}]' END || '}}' AS doc FROM events),
p AS (SELECT event_id, user_id, lag(doc) OVER (PARTITION BY user_id ORDER BY event_id) AS before, doc AS after FROM v),
x AS (SELECT event_id, 'b' AS side, before::JSON AS doc FROM p WHERE before IS NOT NULL UNION ALL SELECT event_id, 'a', after::JSON FROM p WHERE before IS NOT NULL),
f AS (SELECT x.event_id, x.side, t.fullkey AS path, CASE WHEN t.type = 'NULL' THEN 'null' ELSE t.value::VARCHAR END AS value FROM x, json_tree(x.doc) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('{}', '[]')),
c AS (SELECT coalesce(b.event_id, a.event_id) AS event_id, coalesce(b.path, a.path) AS path, b.value AS before, a.value AS after FROM (SELECT * FROM f WHERE side = 'b') b FULL JOIN (SELECT * FROM f WHERE side = 'a') a ON a.event_id = b.event_id AND a.path = b.path WHERE b.value IS DISTINCT FROM a.value)"""


def _version_changes(spark, sf):
    """What changed in an event's settings against those of the user's event before."""
    e = table(spark, sf, "events")
    k = F.col("event_id") % 4
    steps = F.when(k == 0, "[]").when(k == 1, '[1,{"a":null}]').when(k == 2, '"none"').otherwise(F.concat(F.lit('[1,{"a":'), "user_id", F.lit("}]")))
    doc = F.concat(F.lit('{"props":'), "props", F.lit(',"run":{"type":"'), "event_type", F.lit('","steps":'), steps, F.lit("}}"))
    pairs = e.select("event_id", "user_id", doc.alias("after")).withColumn("before", F.lag("after").over(Window.partitionBy("user_id").orderBy("event_id")))
    return nested.changes(pairs.where("before IS NOT NULL"), ["event_id"], "before", "after")


@query(f"WITH {_VERSIONS} SELECT * FROM c")
def nested_changes(spark, sf):
    return _version_changes(spark, sf)


@query(f"WITH {_VERSIONS} SELECT event_id, count(*) AS n, min(path) AS first_path FROM c WHERE path <> '$.props.k' AND NOT starts_with(path, '$.run.steps') GROUP BY 1")
def incompatible_versions(spark, sf):
    """Events whose settings differ from the user's last ones beyond what may differ, and the first such path."""
    bad = nested.incompatible(_version_changes(spark, sf), ["$.props", "$.run.steps"])
    return bad.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    return stream.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total").alias("total"))


@query()
def tumbling_windows_stream(spark, sf):
    """The same windows from a stream of the events, run to its end into the shared folder."""
    return stream.run_to_end(spark, f"{sf}/events.parquet", "6 hours")


@query(f"WITH {_WELL}, a AS ({_atom_sql()}) SELECT 'facts' AS side, count(*) AS n FROM a UNION ALL SELECT 'lost', 0 UNION ALL SELECT 'extra', 0")
def flat_equivalence(spark, sf):
    """Facts of the dealt inventories, and how many reading the flat rendering back loses or makes up, by fields."""
    r = renderings.round_trips(_facts(_good(spark, sf))).agg(F.sum(F.size("facts")).alias("facts"), F.sum("flat_lost").alias("lost"), F.sum("flat_extra").alias("extra"))
    return r.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).cast("long").alias("n")) for s in ("facts", "lost", "extra")])).alias("x")).select("x.*")


@query("""WITH x AS (SELECT d.doc_id AS expected, l.doc_id AS found, l.quality, count(*) OVER (PARTITION BY l.doc_id) AS n FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id)
SELECT coalesce(expected, found) AS doc_id, CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' WHEN quality NOT IN (0, 1) THEN 'enum' ELSE 'ok' END AS violation FROM x""")
def label_file_checks(spark, sf):
    """First violation of each label row against the documents it should cover."""
    n = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("found")).agg(F.count(F.lit(1)).alias("n"), F.min("quality").alias("quality"))
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("expected")).join(n, F.col("expected") == F.col("found"), "full")
    v = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("n") > 1, "duplicate").when(~F.col("quality").isin(0, 1), "enum").otherwise("ok")
    return x.select(F.coalesce("expected", "found").alias("doc_id"), v.alias("violation"))


@query("""WITH d AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '' END AS iso FROM events)
SELECT event_id, epoch(strptime(replace(iso, 'Z', ''), '%Y-%m-%dT%H:%M:%S'))::BIGINT AS seconds, epoch(strptime(substr(iso, 1, 10), '%Y-%m-%d') + INTERVAL 1 DAY - INTERVAL 1 SECOND)::BIGINT AS deadline FROM d""")
def iso_deadlines(spark, sf):
    """ISO times with and without a zone as epoch seconds, and the last second of their day."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    t = F.to_timestamp_ltz(F.regexp_replace(iso, "Z$", "")).alias("t")
    d = table(spark, sf, "events").select("event_id", t)
    return d.select("event_id", F.unix_seconds("t").alias("seconds"), F.unix_seconds(F.date_trunc("day", "t") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")).alias("deadline"))


@query("""SELECT doc_id, sha256('{"images":["' || sha256(text) || '"],"model":"m","prompt":"' || lang || '","temperature":0.0}') AS cache_key FROM documents""")
def cache_key(spark, sf):
    """Key of a request: a hash of its canonical JSON, in which content is replaced by its digest."""
    req = F.to_json(F.struct(F.array(F.sha2("text", 256)).alias("images"), F.lit("m").alias("model"), F.col("lang").alias("prompt"), F.lit(0.0).alias("temperature")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(req, 256).alias("cache_key"))

"""Inventories: schema errors, both renderings and their parsers against plain versions, over hostile texts."""

import copy
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evidence, json_schema, renderings
from tallyloom.plans import graphs

SF = "/root/testdata/sf0.001"


def q(x):
    return json.dumps(x, ensure_ascii=False)


def bare(x):
    return q(x) if x == "" or x != x.strip() or "|" in x or ")" in x or q(x) != f'"{x}"' else x


def number(x):
    return int(re.sub(r"\D", "", x["id"]))


def flat_plainly(inv):
    f, t = inv["query_frame"], inv["temporal_order"]
    basis = lambda x: f" (basis: {bare(x)})" if x is not None else ""
    lines = [renderings.FLAT_HEADER, f"Query frame: {f['frame']}{basis(f['basis'])}.", f"Temporal order: {', '.join(t['order'] or ['unknown'])}{basis(t['basis'])}."]
    lines.append(" ".join(f"Camera {c['id']} took {c['image_id']}." for c in sorted(inv["cameras"], key=number)))
    for e in sorted(inv["entities"], key=number):
        cross = f"; it is the same entity across views (uncertainty {e['cross_view']['uncertainty']})" if e["cross_view"] else ""
        lines.append(f"[{e['id']}] {e['id']} is {'an object' if e['type'] == 'object' else 'a region'} labeled {q(e['label'])}{cross}.")
    for o in sorted(inv["observations"], key=number):
        lines.append(f"[{o['id']}] In {o['image_id']} ({o['where']}), {o['entity']} is observed: {q(o['description'])}.")
    for k in sorted(inv["identity_links"], key=number):
        lines.append(f"[{k['id']}] Identity link between {k['entities'][0]} and {k['entities'][1]} is {k['status']} (uncertainty {k['uncertainty']}).")
    for c in sorted(inv["claims"], key=number):
        what = f"{c['subject']} is {c['predicate']} {c['object']}" if c["kind"] == "relation" else f"attribute {c['predicate']} of {c['subject']} is {q(c['value'])}"
        lead = f"In frame {c['frame']}, for {c['image_id']}" if c["image_id"] else "Across views" if c["frame"] == "unknown" else f"Across views, in frame {c['frame']}"
        note = f" Note: {q(c['note'])}." if c["note"] is not None else ""
        lines.append(f"[{c['id']}] {lead}, {what}. Support: {', '.join(c['support'])}. Uncertainty: {c['uncertainty']}.{note}")
    lines += [f"[u{i}] Unknown: {bare(u)}." for i, u in enumerate(inv["unknowns"], 1)]
    return "\n".join(lines) + "\n"


def graph_plainly(inv):
    f, t = inv["query_frame"], inv["temporal_order"]
    basis = lambda x: f" | basis: {bare(x)}" if x is not None else ""
    tail = lambda c: f"support {','.join(c['support'])} | uncertainty {c['uncertainty']}" + (f" | note {q(c['note'])}" if c["note"] is not None else "")
    where = lambda c: c["image_id"] or "across views"
    lines = [renderings.GRAPH_HEADER, f"Query frame: {f['frame']}{basis(f['basis'])}", f"Temporal order: {', '.join(t['order'] or ['unknown'])}{basis(t['basis'])}", "Nodes:"]
    claims = sorted(inv["claims"], key=number)
    for node in [*sorted(inv["cameras"], key=number), *sorted(inv["entities"], key=number)]:
        if "label" in node:
            cross = f" | cross-view: same (uncertainty {node['cross_view']['uncertainty']})" if node["cross_view"] else ""
            lines.append(f"  {node['id']} [{node['type']}] {q(node['label'])}{cross}")
        else:
            lines.append(f"  {node['id']} [camera] {node['image_id']}")
        lines += [f"    {o['id']} @{o['image_id']} {o['where']}: {q(o['description'])}" for o in sorted(inv["observations"], key=number) if o["entity"] == node["id"]]
        lines += [f"    {c['id']} {c['predicate']} = {q(c['value'])} | {where(c)} | " + (f"frame {c['frame']} | " if c["frame"] != "unknown" else "") + tail(c) for c in claims if c["kind"] == "attribute" and c["subject"] == node["id"]]
    links = [f"  {k['id']} {k['entities'][0]} ~ {k['entities'][1]} | {k['status']} | uncertainty {k['uncertainty']}" for k in sorted(inv["identity_links"], key=number)]
    lines += ["Identity links:", *links] if links else ["Identity links: none"]
    edges = [c for c in claims if c["kind"] == "relation"]
    lines.append("Edges by frame:" if edges else "Edges by frame: none")
    for frame in dict.fromkeys(c["frame"] for c in edges):
        lines.append(f"  {frame}")
        lines += [f"    {c['id']} {c['subject']} -{c['predicate']}-> {c['object']} | {where(c)} | {tail(c)}" for c in edges if c["frame"] == frame]
    unknowns = [f"  u{i} {bare(u)}" for i, u in enumerate(inv["unknowns"], 1)]
    return "\n".join([*lines, *(["Unknowns:", *unknowns] if unknowns else ["Unknowns: none"])]) + "\n"


def drawn(seed):
    """A valid inventory with hostile texts in every place that takes one."""
    r = random.Random(seed)
    text = lambda n: "".join(r.choice([*graphs.HOSTILE, "a", "b ", "c1", "é", "𝄞", "\r", "\x1f", "\x85", "\xa0", "/", "\b"]) for _ in range(r.randrange(6)))[:n]
    level = lambda: r.choice(["low", "medium", "high"])
    maybe = lambda x: r.choice([None, x])
    ids = lambda p, n: [f"{p}{k}" for k in r.sample(range(1, 14), n)]
    ents, obs, images = ids("e", r.randrange(2, 5)), ids("o", 5), ["image_1", "image_2"]
    ordered = r.random() < 0.5
    claims = []
    for c in ids("c", r.randrange(5)):
        relation, frame = r.random() < 0.5, r.choice(["unknown", "image_plane:image_1", "camera:cam2", f"entity:{ents[0]}"])
        claims.append({
            "id": c, "kind": "relation" if relation else "attribute", "subject": r.choice([*ents, "cam1"]), "predicate": r.choice(["left_of", "on"] if relation else ["color", "text"]), "object": r.choice(ents) if relation else None, "value": None if relation else text(60),
            "frame": frame, "image_id": "image_1" if frame.startswith("image") else maybe("image_2"), "support": r.sample(obs, r.randrange(1, 4)), "uncertainty": level(), "note": maybe(text(120)),
        })
    return {
        "schema_version": "ws-1", "query_frame": {"frame": r.choice(["unknown", "camera:cam1"]), "basis": maybe(text(160))}, "temporal_order": {"status": "supported" if ordered else "unknown", "order": r.sample(images, 2) if ordered else None, "basis": text(160) if ordered else None},
        "cameras": [{"id": f"cam{k}", "image_id": f"image_{k}"} for k in (1, 2)], "entities": [{"id": e, "type": r.choice(["object", "region"]), "label": text(60), "cross_view": maybe({"status": "same", "uncertainty": level()})} for e in ents],
        "observations": [{"id": o, "entity": r.choice([*ents, "cam2"]), "image_id": r.choice(images), "where": r.choice(["left", "top_left"]), "description": text(120)} for o in obs],
        "identity_links": [{"id": "i7", "entities": r.sample(ents, 2), "status": "tentative", "uncertainty": level()}][: r.randrange(2)], "claims": claims, "unknowns": [text(200) for _ in range(r.randrange(4))],
    }


def read(spark, docs):
    rows = [(i, json.dumps(d, ensure_ascii=bool(i % 2))) for i, d in enumerate(docs)]
    return evidence.parsed(spark.createDataFrame(rows, "id int, text string"))


def test_renderings_are_those_of_a_plain_version_and_read_back_by_fields(spark):
    docs = [drawn(k) for k in range(500)]
    df = read(spark, docs)
    assert df.where("inv_error IS NOT NULL").count() == 0
    got = renderings.round_trips(renderings.with_facts(df).select("id", "facts")).collect()
    assert len(got) == 500
    for r in got:
        assert r.flat == flat_plainly(docs[r.id]), r.id
        assert r.graph == graph_plainly(docs[r.id]), r.id
        assert (r.flat_lost, r.flat_extra, r.graph_lost, r.graph_extra) == (0, 0, 0, 0)


def test_facts_have_typed_fields(spark):
    f = renderings.with_facts(read(spark, [drawn(3)])).select(F.explode("facts").alias("f")).select("f.*").collect()
    d = drawn(3)
    assert [r.kind for r in f if r.kind == "claim"] == ["claim"] * len(d["claims"])
    for c in d["claims"]:
        r = next(r for r in f if r.atom_id == c["id"])
        assert (r.type, r.subject, r.predicate, r.object, r.text, r.frame, r.image_id, r["items"], r.uncertainty, r.note) == tuple(c[k] for k in ("kind", "subject", "predicate", "object", "value", "frame", "image_id", "support", "uncertainty", "note"))
    assert [r.ordinal for r in f if r.kind == "observation"] == sorted(number(o) for o in d["observations"])


def test_broken_renderings_name_the_line(spark):
    d = drawn(5) | {"unknowns": ["plain"], "identity_links": []}
    flat, graph = flat_plainly(d), graph_plainly(d)
    lines = graph.split("\n")
    edges = next(i for i, x in enumerate(lines) if x.startswith("Edges by frame"))
    flats = {"good": (flat, None), "header": (flat[1:], 1), "no end": (flat.rstrip("\n"), flat.count("\n")), "query": (flat.replace("Query frame: ", "Query: ", 1), 2), "quote": (flat.replace("[u1] Unknown: plain", '[u1] Unknown: "plain'), flat.count("\n")), "more": (flat + "x\n", flat.count("\n") + 1)}
    graphs_ = {"good": (graph, None), "no nodes": (graph.replace("Nodes:\n", "", 1), 4), "section twice": (graph.replace(lines[edges], lines[edges] + "\n" + lines[edges], 1), edges + 2), "loose line": (graph.replace("Identity links: none", "x\nIdentity links: none", 1), lines.index("Identity links: none") + 1), "open none": (graph.replace("Identity links: none", "Identity links: none\n  i1 e1 ~ e2 | tentative | uncertainty low", 1), lines.index("Identity links: none") + 2), "more": (graph + "x\n", len(lines))}
    for cases, parse in ((flats, renderings.parse_flat), (graphs_, renderings.parse_graph)):
        got = {r.name: r.p for r in spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "name string, t string").select("name", parse(F.col("t")).alias("p")).collect()}
        assert {k: got[k].bad_line for k in cases} == {k: line for k, (_, line) in cases.items()}
        assert all((got[k].facts is None) == (k != "good") for k in cases)


def kinds(v):
    return {dict: ["object"], list: ["array"], str: ["string"], bool: ["boolean"], type(None): ["null"], int: ["integer", "number"], float: ["number"]}[type(v)]


def errors_plainly(s, v, path, defs):
    """An interpreter of the same keywords over parsed JSON."""
    out = []
    bad = lambda k: out.append((path, k))
    if "$ref" in s:
        return errors_plainly(defs[s["$ref"].split("/")[-1]], v, path, defs)
    if "type" in s and not set(kinds(v)) & set([s["type"]] if isinstance(s["type"], str) else s["type"]):
        bad("type")
    if "const" in s and v != s["const"]:
        bad("const")
    if "enum" in s and v not in s["enum"]:
        bad("enum")
    if isinstance(v, str):
        if "pattern" in s and not re.search(s["pattern"].replace("$", r"\Z"), v):
            bad("pattern")
        if "maxLength" in s and len(v) > s["maxLength"]:
            bad("maxLength")
    if isinstance(v, list):
        if len(v) < s.get("minItems", 0):
            bad("minItems")
        if len(v) > s.get("maxItems", 1e9):
            bad("maxItems")
        if s.get("uniqueItems") and len({json.dumps(x) for x in v}) < len(v):
            bad("uniqueItems")
        for i, x in enumerate(v):
            out += errors_plainly(s.get("items", {}), x, [*path, str(i)], defs)
    if isinstance(v, dict):
        for k in s.get("required", ()):
            if k not in v:
                bad("required")
        if s.get("additionalProperties") is False and set(v) - set(s["properties"]):
            bad("additionalProperties")
        for k, x in v.items():
            out += errors_plainly(s.get("properties", {}).get(k, {}), x, [*path, k], defs)
    if "anyOf" in s and all(errors_plainly(x, v, path, defs) for x in s["anyOf"]):
        bad("anyOf")
    for x in s.get("allOf", ()):
        out += errors_plainly(x, v, path, defs)
    if "if" in s and not errors_plainly(s["if"], v, path, defs):
        out += errors_plainly(s["then"], v, path, defs)
    return out


def places(v, path=()):
    yield path
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from places(x, (*path, k))


def damaged(seed):
    r = random.Random(seed)
    d = drawn(seed)
    for _ in range(r.randrange(1, 4)):
        path = r.choice([p for p in places(d) if p])
        at = d
        for k in path[:-1]:
            at = at[k]
        action = r.randrange(4)
        if action == 0:
            at[path[-1]] = r.choice([None, 7, 1.5, True, "x" * 201, [], {}, ["a", "a"], "e1", {"id": "e1"}, "unknown", "image_plane:image_3"])
        elif action == 1 and isinstance(at, dict):
            del at[path[-1]]
        elif action == 2 and isinstance(at, dict):
            at["more"] = 1
        elif isinstance(at, list) and at:
            at.extend(copy.deepcopy(at[:1]) * r.choice([1, 40]))
    return d


def test_first_schema_errors_against_a_plain_interpreter(spark):
    docs = [damaged(k) for k in range(400)]
    want = []
    for d in docs:
        e = sorted(errors_plainly(evidence.JSON_SCHEMA, d, [], {}))
        want.append(("/".join(e[0][0]) or "(root)", e[0][1]) if e else None)
    assert sum(x is not None for x in want) > 250 and len({x[1] for x in want if x}) >= 8
    got = {r.id: r.inv_error and (r.inv_error.path, r.inv_error.keyword) for r in read(spark, docs).collect()}
    for i, w in enumerate(want):
        assert got[i] == w, docs[i]


KEYWORDS = {
    "type": ({"type": "integer"}, ["x", 1.5, True, None], [3]), "const": ({"const": "a"}, ["b", 1, None], ["a"]), "enum": ({"enum": ["a", "b"]}, ["c", 1], ["a", "b"]), "pattern": ({"pattern": "^a+$"}, ["b", "a\n"], ["aa", 1]), "maxLength": ({"maxLength": 2}, ["𝄞𝄞𝄞"], ["𝄞𝄞", 5]),
    "minItems": ({"minItems": 1}, [[]], [[1], "x"]), "maxItems": ({"maxItems": 1}, [[1, 2]], [[1], "xy"]), "uniqueItems": ({"uniqueItems": True}, [["a", "a"], [1, 1]], [["a", "b"], []]), "items": ({"items": {"type": "string"}}, [["a", 1]], [["a"], []]),
    "required": ({"required": ["k"]}, [{}], [{"k": None}, []]), "additionalProperties": ({"additionalProperties": False, "properties": {"a": {}}}, [{"b": 1}], [{"a": 1}, {}]), "properties": ({"properties": {"a": {"type": "null"}}}, [{"a": 1}], [{"a": None}, {"b": 1}]),
    "anyOf": ({"anyOf": [{"type": "null"}, {"const": "x"}]}, ["y"], [None, "x"]), "allOf": ({"allOf": [{"type": "string"}, {"maxLength": 1}]}, ["ab", 1], ["a"]), "if": ({"if": {"const": "x"}, "then": {"type": "null"}}, ["x"], ["y", 1]), "$ref": ({"$ref": "#/$defs/s", "$defs": {"s": {"type": "string"}}}, [1], ["a"]),
}


@pytest.mark.parametrize("keyword", sorted(KEYWORDS))
def test_schema_keywords(spark, keyword):
    schema, bad, good = KEYWORDS[keyword]
    rows = [(json.dumps(v), k) for k, vs in ((False, bad), (True, good)) for v in vs]
    for r in spark.createDataFrame(rows, "t string, good boolean").select("t", "good", json_schema.first_violation(schema, F.parse_json("t")).alias("e")).collect():
        assert (r.e is None) == r.good, r


def test_what_surrounds_a_document(spark):
    d = json.dumps(drawn(1))
    cases = {
        d: None, "\n\ufeff" + d + "\n": None, "\ufeff " + d: "format", "```json\n" + d + "\n```": None, "```\n" + d + "```": None, " ```json \r\n" + d + "\n```\n": None, "": "format", "   ": "format", "See: " + d: "format", d + " done": "format", d + "}": "format", d + "]": "format", d + d: "format",
        "```json\n" + d: "format", "```json\n" + d + "\n```\n```\n{}\n```": "format", "```" + d + "```": "format", d[:-2]: "json", "{'a': 1}": "json", "[" + d + "]": "not_object", "3": "not_object", '"x"': "not_object", "null": "not_object", "nul": "format", "{}": "schema",
    }
    got = {r.text: r.inv_error and r.inv_error.rule for r in evidence.parsed(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert got == cases
    assert evidence.parsed(spark.createDataFrame([(None,)], "text string")).first().inv_error.rule == "format"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_inventories_drawn_from_documents(spark):
    import hashlib

    rows = graphs.drawn_inventories(spark, SF).collect()
    got = {r.id: r for r in graphs.inventory_renderings(spark, SF).collect()}
    assert len(got) == len(rows) == 200
    for r in rows:
        d = json.loads(r.text)
        g = got[r.id]
        assert (g.flat_lost, g.flat_extra, g.graph_lost, g.graph_extra) == (0, 0, 0, 0)
        assert g.flat_sha256 == hashlib.sha256(flat_plainly(d).encode()).hexdigest() and g.graph_sha256 == hashlib.sha256(graph_plainly(d).encode()).hexdigest()


def test_parsers_match_each_form_once(spark):
    for parser, forms in ((renderings.parse_flat, 8), (renderings.parse_graph, 9)):
        plan = spark.createDataFrame([("a",)], "t string").select(parser(F.col("t")).alias("r"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_replace(") <= forms, parser
        assert plan.count("regexp_extract(") < 60, parser

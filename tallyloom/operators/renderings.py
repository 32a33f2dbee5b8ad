"""Facts of evidence inventories, their two renderings, and the parsers that read the renderings back by fields.

A fact is a struct of one shape for all eight kinds. An inventory is one row, so rendering and parsing are projections:
nothing is shuffled. Texts are quoted as JSON; a parser takes a quoted text as one token, so whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First lines, kinds in audit order, sentences and lines of both renderings.
FLAT_HEADER = "Evidence extracted by a model from the images (may be incomplete or wrong):"
GRAPH_HEADER = "World state graph extracted by a model from the images (may be incomplete or wrong):"
KINDS = "query_frame temporal_order camera entity observation identity_link claim unknown".split()
SECTIONS = ("Nodes", "Identity links", "Edges by frame", "Unknowns")
LEVELS = "low|medium|high"

_FIELDS = {
    "kind_rank": "int", "ordinal": "int", "atom_id": "string", "kind": "string", "type": "string", "subject": "string", "predicate": "string", "object": "string", "text": "string", "frame": "string",
    "image_id": "string", "place": "string", "items": "array<string>", "status": "string", "uncertainty": "string", "note": "string", "basis": "string",
}
FACT = "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS.items()) + ">"
#: A JSON string, unrolled so that long ones need no deep stack; and the white space that Python strips.
_Q = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _j(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _let(x: Column, f) -> Column:
    """``f`` of a value that is computed once: an expression would be written out, and computed, wherever it is used."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def quoted(x: Column) -> Column:
    """``x`` as a JSON string: the quote, the backslash and control characters are escaped, all others stand."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for c in map(chr, range(32)):
        out = F.replace(out, F.lit(c), F.lit(short.get(c, f"\\u{ord(c):04x}")))
    return _j('"', out, '"')


def quoted_if_needed(x: Column) -> Column:
    """Bare, unless it is empty, has white space at an end, a bar or a closing bracket, or would change when quoted."""
    bare = (x != "") & ~x.rlike(rf"\A{_WS}|{_WS}\z") & ~x.rlike(r'[|)"\\\x00-\x1f]')
    return F.when(bare, x).otherwise(quoted(x))


def unquoted(x: Column) -> Column:
    """The text of a JSON string; null if it is none."""
    whole = x.rlike(rf"(?s)\A{_Q}\z")
    return F.when(whole, F.get(F.from_json(_j("[", x, "]"), "array<string>"), F.lit(0)))


def _maybe_unquoted(x: Column) -> Column:
    return F.when(x.startswith('"'), unquoted(x)).otherwise(x)


def fact(kind: str | Column, **fields: Column) -> Column:
    """A fact of ``kind``; fields that are not named are null. The ordinal is the number in its id, else 0."""
    if isinstance(kind, str):
        kind = F.lit(kind)
    ident = F.coalesce(fields.get("atom_id", F.lit(None).cast("string")), kind)
    number = F.coalesce(F.regexp_extract(ident, r"\A[a-z]+(\d{1,9})\z", 1).try_cast("int"), F.lit(0))
    rank = (F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1).cast("int")
    own = fields | {"kind_rank": rank, "ordinal": number, "atom_id": ident, "kind": kind}
    return F.struct(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()])


def facts(inv: Column) -> Column:
    """The facts of an inventory in audit order: by kind, number in the id, then id. Unknowns are numbered."""
    q, t = inv["query_frame"], inv["temporal_order"]
    each = lambda name, make: F.coalesce(F.transform(inv[name], make), F.array().cast(f"array<{FACT}>"))
    cross = lambda e: e["cross_view"]
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.array(fact("query_frame", frame=q["frame"], basis=q["basis"]), fact("temporal_order", status=t["status"], items=t["order"], basis=t["basis"])),
                each("cameras", lambda c: fact("camera", atom_id=c["id"], image_id=c["image_id"])),
                each("entities", lambda e: fact("entity", atom_id=e["id"], type=e["type"], text=e["label"], status=cross(e)["status"], uncertainty=cross(e)["uncertainty"])),
                each("observations", lambda o: fact("observation", atom_id=o["id"], subject=o["entity"], image_id=o["image_id"], place=o["where"], text=o["description"])),
                each("identity_links", lambda k: fact("identity_link", atom_id=k["id"], items=k["entities"], status=k["status"], uncertainty=k["uncertainty"])),
                each("claims", lambda c: fact("claim", atom_id=c["id"], type=c["kind"], subject=c["subject"], predicate=c["predicate"], object=c["object"], text=c["value"], frame=c["frame"], image_id=c["image_id"], items=c["support"], uncertainty=c["uncertainty"], note=c["note"])),
                each("unknowns", lambda u, i: fact("unknown", atom_id=_j("u", (i + 1).cast("string")), text=u)),
            )
        )
    )


def with_facts(df: DataFrame, inv: str = "inv", out: str = "facts") -> DataFrame:
    """``df`` with its facts as a column. The generator keeps the optimizer from computing them inside later lambdas."""
    return df.select("*", F.explode(F.array(facts(F.col(inv)))).alias(out))


def sentence(f: Column) -> Column:
    """A fact as the sentence of the flat rendering."""
    basis = _j(" (basis: ", quoted_if_needed(f["basis"]), ").")
    label = _j(f["atom_id"], " is ", F.when(f["type"] == "object", "an object").otherwise(_j("a ", f["type"])), " labeled ", quoted(f["text"]))
    action = F.when(f["type"] == "relation", _j(f["subject"], " is ", f["predicate"], " ", f["object"])).otherwise(_j("attribute ", f["predicate"], " of ", f["subject"], " is ", quoted(f["text"])))
    lead = F.when(f["image_id"].isNotNull(), _j("In frame ", f["frame"], ", for ", f["image_id"], ", ")).when(f["frame"] == "unknown", "Across views, ").otherwise(_j("Across views, in frame ", f["frame"], ", "))
    note = F.when(f["note"].isNotNull(), _j(" Note: ", quoted(f["note"]), ".")).otherwise("")
    kind = f["kind"]
    return (
        F.when(kind == "query_frame", _j("Query frame: ", f["frame"], F.when(f["basis"].isNull(), ".").otherwise(basis)))
        .when((kind == "temporal_order") & (f["status"] == "unknown"), "Temporal order: unknown.")
        .when(kind == "temporal_order", _j("Temporal order: ", F.array_join(f["items"], ", "), basis))
        .when(kind == "camera", _j("Camera ", f["atom_id"], " took ", f["image_id"], "."))
        .when(kind == "entity", F.when(f["status"].isNull(), _j(label, ".")).otherwise(_j(label, "; it is the same entity across views (uncertainty ", f["uncertainty"], ").")))
        .when(kind == "observation", _j("In ", f["image_id"], " (", f["place"], "), ", f["subject"], " is observed: ", quoted(f["text"]), "."))
        .when(kind == "identity_link", _j("Identity link between ", F.get(f["items"], F.lit(0)), " and ", F.get(f["items"], F.lit(1)), " is ", f["status"], " (uncertainty ", f["uncertainty"], ")."))
        .when(kind == "claim", _j(lead, action, ". Support: ", F.array_join(f["items"], ", "), ". Uncertainty: ", f["uncertainty"], ".", note))
        .when(kind == "unknown", _j("Unknown: ", quoted_if_needed(f["text"]), "."))
    )


def flat(found: Column) -> Column:
    """The flat rendering of sorted facts: cameras share a line, and each line ends with a line break."""
    of = lambda test: F.filter(found, test)
    heads = F.transform(of(lambda f: f["kind_rank"] < 2), sentence)
    cameras = F.array_join(F.transform(of(lambda f: f["kind"] == "camera"), sentence), " ")
    rest = F.transform(of(lambda f: f["kind_rank"] > 2), lambda f: _j("[", f["atom_id"], "] ", sentence(f)))
    return _j(F.array_join(F.concat(F.array(F.lit(FLAT_HEADER)), heads, F.array(cameras), rest), "\n"), "\n")


def _graph_node(f: Column) -> Column:
    same = F.when(f["status"].isNotNull(), _j(" | cross-view: ", f["status"], " (uncertainty ", f["uncertainty"], ")")).otherwise("")
    return F.when(f["kind"] == "camera", _j(f["atom_id"], " [camera] ", f["image_id"])).otherwise(_j(f["atom_id"], " [", f["type"], "] ", quoted(f["text"]), same))


def _graph_claim(f: Column) -> Column:
    place = F.coalesce(f["image_id"], F.lit("across views"))
    start = F.when(f["type"] == "relation", _j(f["subject"], " -", f["predicate"], "-> ", f["object"], " | ", place)).otherwise(
        _j(f["predicate"], " = ", quoted(f["text"]), " | ", place, F.when(f["frame"] != "unknown", _j(" | frame ", f["frame"])).otherwise(""))
    )
    note = F.when(f["note"].isNotNull(), _j(" | note ", quoted(f["note"]))).otherwise("")
    return _j(f["atom_id"], " ", start, " | support ", F.array_join(f["items"], ","), " | uncertainty ", f["uncertainty"], note)


def graph(found: Column) -> Column:
    """The graph rendering of sorted facts: nodes with what is seen of them, links, and edges by frame in the order in
    which frames appear. ``found`` has to be a column, not an expression: it is read inside lambdas."""
    of = lambda test: F.filter(found, test)
    is_a = lambda f, kind, type_=None: (f["kind"] == kind) & (F.lit(True) if type_ is None else f["type"] == type_)
    q, t = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    basis = lambda f: F.when(f["basis"].isNotNull(), _j(" | basis: ", quoted_if_needed(f["basis"]))).otherwise("")
    heads = F.array(F.lit(GRAPH_HEADER), _j("Query frame: ", q["frame"], basis(q)), F.when(t["status"] == "unknown", "Temporal order: unknown").otherwise(_j("Temporal order: ", F.array_join(t["items"], ", "), basis(t))), F.lit("Nodes:"))

    def node(n: Column) -> Column:
        seen = F.transform(of(lambda f: is_a(f, "observation") & (f["subject"] == n["atom_id"])), lambda f: _j("    ", f["atom_id"], " @", f["image_id"], " ", f["place"], ": ", quoted(f["text"])))
        said = F.transform(of(lambda f: is_a(f, "claim", "attribute") & (f["subject"] == n["atom_id"])), lambda f: _j("    ", _graph_claim(f)))
        return F.concat(F.array(_j("  ", _graph_node(n))), seen, said)

    frames = F.array_distinct(F.transform(of(lambda f: is_a(f, "claim", "relation")), lambda f: f["frame"]))
    edges = F.transform(frames, lambda x: F.concat(F.array(_j("  ", x)), F.transform(of(lambda f: is_a(f, "claim", "relation") & (f["frame"] == x)), lambda f: _j("    ", _graph_claim(f)))))
    links = F.transform(of(lambda f: is_a(f, "identity_link")), lambda f: _j("  ", f["atom_id"], " ", F.get(f["items"], F.lit(0)), " ~ ", F.get(f["items"], F.lit(1)), " | ", f["status"], " | uncertainty ", f["uncertainty"]))
    unknowns = F.transform(of(lambda f: is_a(f, "unknown")), lambda f: _j("  ", f["atom_id"], " ", quoted_if_needed(f["text"])))
    part = lambda name, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"{name}:")), lines)).otherwise(F.array(F.lit(f"{name}: none")))
    nodes = F.flatten(F.transform(of(lambda f: f["kind"].isin("camera", "entity")), node))
    return _j(F.array_join(F.concat(heads, nodes, part(SECTIONS[1], links), part(SECTIONS[2], F.flatten(edges)), part(SECTIONS[3], unknowns)), "\n"), "\n")


_FORMS = {
    "query": r"\AQuery frame: (\S+?)(?: \(basis: (.*)\))?\.\z",
    "order": r"\ATemporal order: (?:(unknown)|(image_[1-9]\d*(?:, image_[1-9]\d*)*) \(basis: (.*)\))\.\z",
    "entity": rf"\A\[(e\d+)\] (e\d+) is an? (object|region) labeled ({_Q})(?:; it is the same entity across views \(uncertainty ({LEVELS})\))?\.\z",
    "observation": rf"\A\[(o\d+)\] In (image_\d+) \(([a-z_]+)\), (\S+) is observed: ({_Q})\.\z",
    "link": rf"\A\[(i\d+)\] Identity link between (\S+) and (\S+) is (tentative|different) \(uncertainty ({LEVELS})\)\.\z",
    "claim": (
        rf"\A\[(c\d+)\] (?:In frame (\S+), for (image_\d+)|Across views(?:, in frame (\S+))?), (?:attribute ([a-z_]+) of (\S+) is ({_Q})|(\S+) is ([a-z_]+) (\S+))"
        rf"\. Support: (o[1-9]\d*(?:, o[1-9]\d*)*)\. Uncertainty: ({LEVELS})\.(?: Note: ({_Q})\.)?\z"
    ),
    "unknown": r"\A\[(u\d+)\] Unknown: (.*)\.\z",
    "g_query": r"\AQuery frame: (\S+?)(?: \| basis: (.*))?\z",
    "g_order": r"\ATemporal order: (?:(unknown)|(image_[1-9]\d*(?:, image_[1-9]\d*)*) \| basis: (.*))\z",
    "g_camera": r"\A(cam\d+) \[camera\] (image_\d+)\z",
    "g_entity": rf"\A(e\d+) \[(object|region)\] ({_Q})(?: \| cross-view: (\S+) \(uncertainty ({LEVELS})\))?\z",
    "g_observation": rf"\A(o\d+) @(image_\d+) ([a-z_]+): ({_Q})\z",
    "g_attribute": rf"\A(c\d+) ([a-z_]+) = ({_Q}) \| (across views|image_\d+)(?: \| frame (\S+))? \| support (o[1-9]\d*(?:,o[1-9]\d*)*) \| uncertainty ({LEVELS})(?: \| note ({_Q}))?\z",
    "g_edge": rf"\A(c\d+) (\S+) -([a-z_]+)-> (\S+) \| (across views|image_\d+) \| support (o[1-9]\d*(?:,o[1-9]\d*)*) \| uncertainty ({LEVELS})(?: \| note ({_Q}))?\z",
    "g_link": rf"\A(i\d+) (\S+) ~ (\S+) \| (tentative|different) \| uncertainty ({LEVELS})\z",
    "g_unknown": r"\A(u\d+) (.*)\z",
}


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern.replace(r"\z", r"\Z")).groups


def _is(line: Column, name: str, make) -> Column:
    """``make`` of the groups of a line that has a form, else null; a group that took no part is null.

    One match gives all groups: they are put together with line breaks, which no line holds.
    """
    n = _groups(_FORMS[name])
    groups = F.split(F.regexp_replace(line, f"(?s){_FORMS[name]}", "\n".join(f"${i}" for i in range(1, n + 1))), "\n", -1)
    # No group that took part can be empty but those of a bare text, which are told apart by their form.
    return _let(groups, lambda g: F.when(F.size(g) == n, make(*[F.nullif(F.get(g, F.lit(i)), F.lit("")) for i in range(n)])))


def _order(unknown: Column, order: Column, basis: Column) -> Column:
    return fact("temporal_order", status=F.when(unknown.isNotNull(), "unknown").otherwise("supported"), items=F.split(order, ", "), basis=_maybe_unquoted(basis))


def _sound(f: Column) -> Column:
    """A fact, or null if a text that it has to have could not be read."""
    needs = f["kind"].isin("entity", "observation", "unknown") | (f["type"] == "attribute")
    return F.when(~(F.coalesce(needs, F.lit(False)) & f["text"].isNull()), f)


def _flat_line(line: Column, i: Column) -> Column:
    """The facts of a line; an empty array if it fits nothing."""
    one = F.coalesce(
        F.when(i == 1, _is(line, "query", lambda frame, basis: fact("query_frame", frame=frame, basis=_maybe_unquoted(basis)))),
        F.when(i == 2, _is(line, "order", _order)),
        F.when(
            i > 3,
            F.coalesce(
                _is(line, "entity", lambda ident, again, type_, label, level: F.when(ident == again, fact("entity", atom_id=ident, type=type_, text=unquoted(label), status=F.when(level.isNotNull(), "same"), uncertainty=level))),
                _is(line, "observation", lambda ident, image, place, subject, text: fact("observation", atom_id=ident, subject=subject, image_id=image, place=place, text=unquoted(text))),
                _is(line, "link", lambda ident, a, b, status, level: fact("identity_link", atom_id=ident, items=F.array(a, b), status=status, uncertainty=level)),
                _is(
                    line,
                    "claim",
                    lambda ident, frame, image, across, attribute, of, value, subject, predicate, target, support, level, note: fact(
                        "claim", atom_id=ident, type=F.when(attribute.isNotNull(), "attribute").otherwise("relation"), subject=F.coalesce(of, subject), predicate=F.coalesce(attribute, predicate),
                        object=target, text=unquoted(value), frame=F.coalesce(frame, across, F.lit("unknown")), image_id=image, items=F.split(support, ", "), uncertainty=level, note=unquoted(note),
                    ),
                ),
                _is(line, "unknown", lambda ident, text: fact("unknown", atom_id=ident, text=_maybe_unquoted(text))),
            ),
        ),
    )
    camera = r"Camera (cam\d+) took (image_\d+)\."
    ids, images = (F.regexp_extract_all(line, F.lit(camera), F.lit(k)) for k in (1, 2))
    cameras = F.when((i == 3) & line.rlike(rf"\A(?:{camera}(?: (?!\z)|\z))*\z"), F.zip_with(ids, images, lambda a, b: fact("camera", atom_id=a, image_id=b)))
    return F.coalesce(cameras, _let(one, lambda o: F.when(_sound(o).isNotNull(), F.array(o))), F.array().cast(f"array<{FACT}>"))


_READ = f"struct<facts:array<{FACT}>,bad_line:int>"


def parse_flat(text: Column) -> Column:
    """``facts`` in audit order of a flat rendering, and ``bad_line``: the first line, from 1, that cannot be read, null
    if all can. With a bad line, facts are null. A text has to end with a line break."""
    lines = F.split(text, "\n", -1)
    each = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.when(i == 0, x == FLAT_HEADER).when(i == F.size(lines) - 1, x == "").when((i == 3) & (x == ""), True).alias("good"), _flat_line(x, i).alias("facts")))
    return _read(each)


def _read(each: Column) -> Column:
    return _let(each, _read_lines)


def _read_lines(each: Column) -> Column:
    bad = F.filter(each, lambda e: ~F.coalesce(e["good"], F.size(e["facts"]) > 0))
    first = F.get(bad, F.lit(0))["line"]
    return F.struct(F.when(first.isNull(), F.array_sort(F.flatten(F.transform(each, lambda e: e["facts"])))).alias("facts"), first.alias("bad_line"))


def _graph_lines(text: Column) -> Column:
    """Lines with their place in the grammar, by a fold that keeps the section, whether it may have lines, and the head
    (node or frame) that deeper lines belong to."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("section"), F.lit(False).alias("open"), F.lit(None).cast("string").alias("head"), F.array().cast("array<struct<line:int,section:int,depth:int,head:string,body:string,good:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"]
        depth = F.when(x.startswith("    "), 2).when(x.startswith("  "), 1).otherwise(0)
        names = [F.when(x == f"{name}:", 1).when(x == f"{name}: none", 2) for name in SECTIONS]
        # A section's first line stands where the one before it may end.
        opens = F.when((n == 3) & (names[0] == 1), 1).when((a["section"] == 1) & names[1].isNotNull(), 2).when((a["section"] == 2) & names[2].isNotNull(), 3).when((a["section"] == 3) & names[3].isNotNull(), 4)
        opened = F.coalesce(names[0], names[1], names[2], names[3]) == 1
        inside = (depth > 0) & a["open"]
        last = (x == "") & (a["section"] == 4)
        good = F.when(n == 0, x == GRAPH_HEADER).when(n < 3, F.lit(None).cast("boolean")).when(opens.isNotNull() | last, True).when(inside, F.lit(None).cast("boolean")).otherwise(False)
        body = F.when(n < 3, x).otherwise(F.substring(x, depth * 2 + 1, F.length(x)))
        head = F.when(opens.isNotNull(), F.lit(None).cast("string")).when(inside & (depth == 1), F.when(a["section"] == 1, F.regexp_extract(body, r"\A(\S+)", 1)).when(a["section"] == 3, body)).otherwise(a["head"])
        entry = F.struct((n + 1).alias("line"), F.when(n < 3, F.lit(0)).otherwise(F.coalesce(opens, a["section"])).alias("section"), depth.alias("depth"), head.alias("head"), body.alias("body"), good.alias("good"))
        return F.struct((n + 1).alias("n"), F.coalesce(opens, a["section"]).alias("section"), F.when(last, False).when(opens.isNotNull(), opened).otherwise(a["open"]).alias("open"), head.alias("head"), F.array_append(a["out"], entry).alias("out"))

    return F.aggregate(lines, start, step, lambda a: F.when(F.element_at(a["out"], -1)["body"] == "", a["out"]).otherwise(F.array_append(a["out"], F.struct((a["n"] + 1).alias("line"), F.lit(9).alias("section"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("head"), F.lit("").alias("body"), F.lit(False).alias("good")))))


def parse_graph(text: Column) -> Column:
    """As ``parse_flat``, of a graph rendering."""
    place = lambda x: F.nullif(x, F.lit("across views"))

    def read(e: Column) -> Column:
        b, at = e["body"], lambda section, depth: (e["section"] == section) & (e["depth"] == depth)
        top = F.when(
            e["section"] == 0,
            F.coalesce(F.when(e["line"] == 2, _is(b, "g_query", lambda frame, basis: fact("query_frame", frame=frame, basis=_maybe_unquoted(basis)))), F.when(e["line"] == 3, _is(b, "g_order", _order))),
        )
        node = F.when(
            at(1, 1),
            F.coalesce(
                _is(b, "g_camera", lambda ident, image: fact("camera", atom_id=ident, image_id=image)),
                _is(b, "g_entity", lambda ident, type_, label, status, level: fact("entity", atom_id=ident, type=type_, text=unquoted(label), status=status, uncertainty=level)),
            ),
        )
        child = F.when(
            at(1, 2) & e["head"].isNotNull(),
            F.coalesce(
                _is(b, "g_observation", lambda ident, image, where, text: fact("observation", atom_id=ident, subject=e["head"], image_id=image, place=where, text=unquoted(text))),
                _is(b, "g_attribute", lambda ident, name, value, image, frame, support, level, note: fact("claim", atom_id=ident, type=F.lit("attribute"), subject=e["head"], predicate=name, text=unquoted(value), frame=F.coalesce(frame, F.lit("unknown")), image_id=place(image), items=F.split(support, ","), uncertainty=level, note=unquoted(note))),
            ),
        )
        link = F.when(at(2, 1), _is(b, "g_link", lambda ident, a, c, status, level: fact("identity_link", atom_id=ident, items=F.array(a, c), status=status, uncertainty=level)))
        edge = F.when(at(3, 2) & e["head"].isNotNull(), _is(b, "g_edge", lambda ident, subject, name, target, image, support, level, note: fact("claim", atom_id=ident, type=F.lit("relation"), subject=subject, predicate=name, object=target, frame=e["head"], image_id=place(image), items=F.split(support, ","), uncertainty=level, note=unquoted(note))))
        unknown = F.when(at(4, 1), _is(b, "g_unknown", lambda ident, text: fact("unknown", atom_id=ident, text=_maybe_unquoted(text))))
        one = F.coalesce(top, node, child, link, edge, unknown)
        frame = at(3, 1) & e["body"].rlike(r"\A\S+\z")
        found = F.when(~F.coalesce(e["good"], F.lit(False)), _let(one, lambda o: F.when(_sound(o).isNotNull(), F.array(o))))
        return F.struct(e["line"], F.coalesce(e["good"], F.when(frame, True)).alias("good"), F.coalesce(found, F.array().cast(f"array<{FACT}>")).alias("facts"))

    return _read(F.transform(_graph_lines(text), read))


def round_trips(df: DataFrame) -> DataFrame:
    """``df`` (id, facts) with both renderings and what is lost or made up by rendering and parsing again, by fields."""
    texts = df.select("*", F.explode(F.array(F.struct(flat(F.col("facts")).alias("flat"), graph(F.col("facts")).alias("graph")))).alias("r")).select(*df.columns, "r.*")
    read = texts.select("*", F.explode(F.array(F.struct(parse_flat(F.col("flat"))["facts"].alias("f"), parse_graph(F.col("graph"))["facts"].alias("g")))).alias("r")).select(*texts.columns, "r.*")
    none = F.array().cast(f"array<{FACT}>")
    size = lambda a, b: F.size(F.array_except(F.coalesce(a, none), F.coalesce(b, none))).cast("long")
    x, f, g = F.col("facts"), F.col("f"), F.col("g")
    return read.withColumns({"flat_lost": size(x, f), "flat_extra": size(f, x), "graph_lost": size(x, g), "graph_extra": size(g, x)}).drop("f", "g")

"""JSON Schemas compiled into columns over VARIANT.

``violations`` gives every broken keyword of a document as (path, keyword), ordered by path. A path lists keys and
places in arrays as text, so paths compare as lists of texts do. Supported keywords: type, const, enum, pattern,
maxLength, minItems, maxItems, uniqueItems, items, required, properties, additionalProperties (false), anyOf, allOf,
if/then and $ref into $defs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIOLATION = "struct<path:array<string>,keyword:string>"


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _at(path: Column, keyword: str) -> Column:
    return F.struct(path.alias("path"), F.lit(keyword).alias("keyword"))


def _if(bad: Column, path: Column, keyword: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_at(path, keyword))).otherwise(_none())


def kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer or number; null for a missing value."""
    return _kind(F.schema_of_variant(v))


def _kind(k: Column) -> Column:
    named = F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array")
    for name, shown in (("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"), ("BIGINT", "integer")):
        named = named.when(k == name, shown)
    return named.when(k.isNotNull(), "number")


def _node(v: Column) -> Column:
    """A value with its type and what it holds as text, fields or elements."""
    s = F.schema_of_variant(v)
    return F.struct(
        s.alias("s"),
        v.alias("v"),
        F.when(s == "STRING", F.try_variant_get(v, "$", "string")).alias("text"),
        F.when(s.startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")).alias("fields"),
        F.when(s.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).alias("elements"),
    )


def _check(schema: dict, v: Column, path: Column, defs: dict) -> Column:
    """Violations of the value ``v``, which is present.

    The value is bound to a lambda's variable: as an expression it would be written out, and computed, once for each
    keyword at every depth.
    """
    return F.flatten(F.transform(F.array(_node(v)), lambda n: _broken(schema, n, path, defs)))


def _broken(schema: dict, n: Column, path: Column, defs: dict) -> Column:
    """Violations of a node."""
    if "$ref" in schema:
        return _broken(defs[schema["$ref"].rsplit("/", 1)[-1]], n, path, defs)
    out: list[Column] = []
    text, fields, xs = n["text"], n["fields"], n["elements"]
    holds = lambda sub: F.size(_broken(sub, n, F.array().cast("array<string>"), defs)) == 0
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        names += ["integer"] if "number" in names else []
        out.append(_if(~_kind(n["s"]).isin(*names), path, "type"))
    if "const" in schema:
        out.append(_if(~text.eqNullSafe(F.lit(schema["const"])), path, "const"))
    if "enum" in schema:
        out.append(_if(text.isNull() | ~text.isin(*schema["enum"]), path, "enum"))
    if "pattern" in schema:
        # "$" of a schema ends the text: in Java it would also stand before a last line break.
        out.append(_if(~text.rlike(schema["pattern"].removesuffix("$") + r"\z" * schema["pattern"].endswith("$")), path, "pattern"))
    if "maxLength" in schema:
        out.append(_if(F.length(text) > schema["maxLength"], path, "maxLength"))
    if "minItems" in schema:
        out.append(_if(F.size(xs) < schema["minItems"], path, "minItems"))
    if "maxItems" in schema:
        out.append(_if(F.size(xs) > schema["maxItems"], path, "maxItems"))
    if schema.get("uniqueItems"):
        texts = F.transform(xs, lambda x: F.to_json(x))
        out.append(_if(F.size(F.array_distinct(texts)) < F.size(texts), path, "uniqueItems"))
    if "items" in schema:
        each = F.transform(xs, lambda x, i: _check(schema["items"], x, F.concat(path, F.array(i.cast("string"))), defs))
        out.append(F.coalesce(F.flatten(each), _none()))
    for name in schema.get("required", ()):
        out.append(_if(~F.map_contains_key(fields, name), path, "required"))
    if schema.get("additionalProperties") is False:
        out.append(_if(F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, schema["properties"])))) > 0, path, "additionalProperties"))
    for name, sub in schema.get("properties", {}).items():
        found = _check(sub, fields[name], F.concat(path, F.array(F.lit(name))), defs)
        out.append(F.when(F.coalesce(F.map_contains_key(fields, name), F.lit(False)), found).otherwise(_none()))
    if "anyOf" in schema:
        good = F.lit(False)
        for sub in schema["anyOf"]:
            good |= holds(sub)
        out.append(_if(~good, path, "anyOf"))
    for sub in schema.get("allOf", ()):
        out.append(_broken(sub, n, path, defs))
    if "if" in schema:
        out.append(F.when(holds(schema["if"]), _broken(schema["then"], n, path, defs)).otherwise(_none()))
    return F.concat(*out) if len(out) > 1 else out[0] if out else _none()


def violations(schema: dict, v: Column) -> Column:
    """All violations of a document, sorted by path, then keyword; null for a null document."""
    return F.when(v.isNotNull(), F.array_sort(_check(schema, v, F.array().cast("array<string>"), schema.get("$defs", {}))))


def first_violation(schema: dict, v: Column) -> Column:
    """The first of the sorted violations as (path, keyword), the path joined by slashes, ``(root)`` for the document."""
    shown = lambda x: F.when(x.isNotNull(), F.struct(F.coalesce(F.nullif(F.array_join(x["path"], "/"), F.lit("")), F.lit("(root)")).alias("path"), x["keyword"].alias("keyword")))
    return F.get(F.transform(F.array(F.get(violations(schema, v), F.lit(0))), shown), F.lit(0))

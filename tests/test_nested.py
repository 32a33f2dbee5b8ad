import json
import random

from tallyloom.operators import nested


def leaves(x, path="$"):
    if isinstance(x, dict) and x:
        out = {}
        for k, v in x.items():
            plain = k.isascii() and k.isidentifier()
            out |= leaves(v, f"{path}.{k if plain else json.dumps(k, ensure_ascii=False)}")
        return out
    if isinstance(x, list) and x:
        return {p: v for i, e in enumerate(x) for p, v in leaves(e, f"{path}[{i}]").items()}
    return {path: json.dumps(x, ensure_ascii=False, separators=(",", ":"))}


def drawn(r, depth):
    kind = r.randrange(8) if depth else r.randrange(4, 8)
    if kind < 2:
        return {r.choice(["a", "b", "c d", 'q"', "x.y", "é", ""]): drawn(r, depth - 1) for _ in range(r.randrange(4))}
    if kind < 4:
        return [drawn(r, depth - 1) for _ in range(r.randrange(4))]
    return r.choice([None, True, 3, "t", "}]{", 'a"b', "", -7])


def test_changes_match_a_plain_comparison(spark):
    r = random.Random(4)
    rows, want = [], set()
    for k in range(150):
        a, b = {"top": drawn(r, 4)}, {"top": drawn(r, 4)}
        rows.append((k, json.dumps(a), json.dumps(b)))
        x, y = leaves(a), leaves(b)
        want |= {(k, p, x.get(p), y.get(p)) for p in x.keys() | y.keys() if x.get(p) != y.get(p)}
    got = nested.changes(spark.createDataFrame(rows, "id long, l string, r string"), ["id"], "l", "r")
    assert {tuple(x) for x in got.collect()} == want


def test_edges(spark):
    rows = [(1, None, '{"a":1}'), (2, "{", '{"a":1}'), (3, "{}", "[]"), (4, '{"a":1.0}', '{"a":1}'), (5, '{"a":1,"a":2}', None), (6, '{"a":{"b":1}}', '{"a":5}')]
    got = nested.changes(spark.createDataFrame(rows, "path2 long, l string, r string"), ["path2"], "l", "r")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "$.a", None, "1"), (2, "$.a", None, "1"), (3, "$", "{}", "[]"), (6, "$.a", None, "5"), (6, "$.a.b", "1", None)]
    assert [x[0] for x in nested.incompatible(got, ["$.a"]).collect()] == [3]
    assert nested.changes(spark.createDataFrame([], "id long, l string, r string"), ["id"], "l", "r").count() == 0

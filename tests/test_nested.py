from __future__ import annotations

import json

from quarrykit.operators import nested


def found(spark, rows):
    df = spark.createDataFrame([(str(i), a, b, "clash") for i, (a, b) in enumerate(rows)], "k string, result string, agent_events string, path string")
    return {(r.k, r.path, r.parent_path) for r in nested.element_objects(df, "k", ["result", "agent_events"]).collect()}


def brute(rows):
    out = set()

    def walk(k, v, path, owner):
        if isinstance(v, dict):
            for name, x in v.items():
                walk(k, x, f"{path}.{name}", owner)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                at = f"{path}[{i}]"
                if isinstance(x, dict):
                    out.add((k, at, owner))
                walk(k, x, at, at if isinstance(x, dict) else owner)

    for i, row in enumerate(rows):
        for c, t in zip(("result", "agent_events"), row):
            try:
                v = json.loads(t)
                v = json.loads(v) if isinstance(v, str) else v
            except (TypeError, ValueError):
                continue
            walk(str(i), v, c, c)
    return out


def test_all_shapes(spark):
    deep = '{"a": 1}'
    for i in range(40):
        deep = '{"x.%d": [%s, [%s]]}' % (i, deep, 1) if i % 2 else "[%s, 2]" % deep
    rows = [
        ('{"a": {"b": [{"c": [1, {"d": null}]}]}}', "[]"), (None, ""), ("  ", "null"), ('"[{\\"x\\": [{}]}]"', '"plain"'), ("[1, 2", '{"a": [{"b": 1}'), ("[] []", '{"a":[{}]} x'),
        ('[{"a": "[{\\"no\\": 1}]"}]', '[[{"a": 1}], "{", 3]'), (deep, '{"src/a.py": [{"é": [{}]}], "": [{"q\\"r": [{}]}]}'), ('{"s": "\\\\\\"[{"}', "{}"),
    ]
    assert found(spark, rows) == brute(rows)


def test_flat_table_keeps_links(spark):
    text = '{"modules": [{"module": "m", "files": [{"file_path": "a", "functions": [{"name": "f", "lines": "x"}, 3]}]}, null, {"files": {}}]}'
    df = spark.createDataFrame([("j", text), ("n", None)], "k string, result string")
    rows = nested.flat_table(df, "k", "result", ["modules", "files", "functions"], {"name": "string", "lines": "bigint"}).collect()
    assert [tuple(r) for r in rows] == [("j", "result.modules[0].files[0].functions[0]", "result.modules[0].files[0]", "f", None)]


def test_latest_takes_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, None, "z")], "k string, t int, v string")
    assert {tuple(r) for r in nested.latest(df, ["k"], ["v"], ["t"]).collect()} == {("a", "y"), (None, "z")}

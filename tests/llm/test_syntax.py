from __future__ import annotations

import ast

import pytest

from quarrykit.llm import grammar, lexer, syntax

VALID = {
    "a.py": ['def f(x):\n    """=======\n<<<<<<< HEAD\n"""\n    try:\n        return [y for y in x if y][1:]\n    except ValueError as e:\n        raise\n    finally:\n        pass\n', "x = {'a': 1, **b}\nif x: y = 1\nelse: y = 2\n", "async def g():\n    async with a as b, c:\n        await b(*c)\n    return not x is None\n"],
    "a.js": ["const a = x => ({ ...x, b: `}${a}` });\nfor (const v of a) if (v) continue;\nexport default class A extends B { static m() { return /[{(\\[]+/g.test(s) } }\nlet s = 1\nlet t = a\n  ? b : c\n"],
    "a.ts": ["export async function f<T>(a: T[], b?: number): Promise<Map<string, T>> {\n  return a.map((x) => x as T)!;\n}\ninterface O { readonly a: string | null; b?(): void }\ntype U = A | B;\n"],
    "a.go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\ntype S struct {\n\tn int\n}\n\nfunc (s *S) F(x []int) (map[int]int, error) {\n\tfor i, v := range x {\n\t\tif v > 1 {\n\t\t\tcontinue\n\t\t}\n\t\tm[i%2] = v\n\t}\n\treturn nil, fmt.Errorf(`\n<<<<<<< HEAD\n`)\n}\n"],
    "A.java": ["package a.b;\n\nimport java.util.List;\n\n@Service(\"x\")\npublic class A<T> extends B implements C {\n    private final Map<String, List<Integer>> m = new HashMap<>();\n    public static int f(List<Integer> a) throws E {\n        for (int x : a) { if (x > 1 && a.size() < 3) continue; }\n        return a.stream().map(v -> v + 1).toList().get(0);\n    }\n}\n"],
    "a.cs": ["using System;\n\nnamespace A.B;\n\n[Attr]\npublic class C : D\n{\n    public int? P { get; set; } = 1;\n    public static IEnumerable<int> F(List<int> a) => a.Where(x => x > 1 && x is int);\n    string s = @\"\n=======\n\";\n}\n"],
    "a.rs": ["use std::collections::HashMap;\n\n#[derive(Debug)]\npub struct S<'a> { a: &'a str }\n\nfn f(x: &[i64], y: i64) -> Vec<i64> {\n    let mut v = vec![1, 2];\n    for i in x.iter() { if *i < y { continue; } v.push(*i as i64); }\n    x.iter().copied().filter(|e| *e > y).collect()\n}\nconst T: &str = r#\"\n>>>>>>> x\n\"#;\n"],
    "a.php": ["<?php\n\nnamespace App;\n\nclass A\n{\n    private function f(array $a, int $b = 3): ?int {\n        $c = array_filter($a, function ($x) use ($b) {\n            return $x > $b;\n        });\n        return $this->g['a'] ?? null;\n    }\n}\n", "plain output"],
    "a.rb": ["require 'x'\n\n# (\ndef f(a, b = 3)\n  return [] if a.empty?\n  a.each do |x|\n    next if x < b\n    y = \"#{x} {\"\n  end\n  a.select { |v| v > b }.sort.first(2)\nend\n\nclass A < B\n  attr_reader :a\nend\n"],
}
FOREIGN = {"sh": "#!/bin/sh\nset -eu\nif [ -f a ]; then\n  rm -r a\nfi\n", "css": ".a {\n  color: #334455;\n  margin: 0 auto;\n}\n", "json": '{\n  "name": "a",\n  "files": ["b"]\n}\n', "html": "<!DOCTYPE html>\n<html>\n<p>a b c</p>\n</html>\n", "sql": "-- t\nCREATE TABLE a (\n  id BIGINT NOT NULL\n);\n"}


def check(spark, rows):
    df = spark.createDataFrame([(i, p, s, "clash") for i, (p, s) in enumerate(rows)], "file_id int, file_path string, source string, kind string")
    return {r.file_id for r in syntax.faults(df).collect()}


def test_valid_files_pass(spark):
    rows = [(p, s) for p, texts in VALID.items() for s in texts]
    assert [rows[i] for i in check(spark, rows)] == []


def test_broken_files_are_found(spark):
    rows = []
    for p, texts in VALID.items():
        s = texts[0]
        lines = s.split("\n")
        mid = len(lines) // 2
        rows += [(p, "\n".join([*lines[:mid], "<<<<<<< HEAD", *lines[mid : mid + 1], "=======", ">>>>>>> b", *lines[mid + 1 :]])), (p, s[: int(len(s) * 0.6)].rstrip() + " (")]
    assert set(range(len(rows))) == check(spark, rows)


def test_other_languages_are_found(spark):
    rows = [(p, s) for p in VALID if not p.endswith((".php", ".rb")) for k, s in FOREIGN.items() if not (k == "json" and p.endswith(".py"))]
    assert [rows[i] for i in set(range(len(rows))) - check(spark, rows)] == []


def test_what_is_not_checked(spark):
    assert check(spark, [("a.py", None), ("a.py", ""), ("a.txt", "(("), (None, "(("), ("a", "((")]) == set()


@pytest.mark.parametrize("cut", range(10, 400, 13))
def test_python_as_the_parser_says(cut):
    text = "\n".join(VALID["a.py"])[:cut]
    try:
        ast.parse(text)
        good = True
    except SyntaxError:
        good = False
    tokens = lexer.tokens(text, "python")
    allowed = grammar.permitted("python")
    flat = all((a, b) in allowed for (a, _), (b, _) in zip(tokens, tokens[1:]))
    assert flat or not good  # what the parser takes, the pairs permit


def test_rates(spark):
    df = spark.createDataFrame([(1, "a.py", "x = (", "r", "python"), (2, "b.py", "x = 1", "r", "python"), (3, "c.py", None, None, None)], "file_id int, file_path string, source string, repo_url string, language string")
    assert {tuple(r) for r in syntax.rates(df).collect()} == {("r", "python", 2, 1, 0.5), (None, None, 1, 0, 0.0)}

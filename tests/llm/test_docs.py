from __future__ import annotations

import pytest

from quarrykit.llm import docs

TELLS = [
    ("python", "f_x", 'def f_x(a):\n    """Keeps the newest entries."""\n    return {a}\n'), ("python", "f", "@deco(1)\nasync def f(\n    a: int = 3,\n) -> dict:\n    # noqa\n    r'''Never raises, even on broken input.'''\n"),
    ("braces", "go", "/**\n * Walks the folder once.\n * @param {number} x\n */\nexport function go(x) { return `}${x}`; }"), ("braces", "Load", "// Load reads every bucket twice.\nfunc (s *S) Load(x []int) int {\n\treturn 1\n}"),
    ("braces", "p", "    /// <summary>Expects bytes in UTF-8.</summary>\n    [Obsolete(\"x]\")]\n    public int P(int a)\n    {\n        return a;\n    }"), ("ruby", "f", "# Order of equal values is kept.\n# @param x [Array]\ndef f(x)\n  x\nend"),
    ("braces", "f", "/// Safe to call twice.\n#[inline]\nfn f() {}"), ("python", "split", 'def split(x):\n    """Splits the split: order is kept in any case."""'),
]
SILENT = [
    ("python", "f", "def f(a):\n    return 1\n"), ("python", "f", "# A comment that is no docstring of f\ndef f(a):\n    pass"), ("python", "load_x", 'def load_x():\n    """This function simply loads the given x and returns it."""'),
    ("python", "f", 'def f():\n    """TODO: explain what happens here"""'), ("python", "f", 'def f(a):\n    """\n    Args:\n        a: the input\n    """'), ("braces", "f", "/** */\nfunction f() {}"), ("braces", "f", "// eslint-disable-next-line complexity\nfunction f() {}"),
    ("braces", "f", "// ======== edge ========\nfunction f() {}"), ("braces", "f", "// total = legacy(a, b);\nfunction f() {}"), ("braces", "applyIt", "// Applies it.\nfunction applyIt() {}"), ("braces", "f", "/// # Arguments\n/// * `a`\nfn f(a: i32) {}"),
    ("python", "f", "def f():\n    '''N/A'''"), ("python", "f", ""), ("python", "f", None), ("ruby", "f", "# -----------\ndef f\nend"), ("python", "f", 'def f():\n    x = "not a docstring of any kind"'),
]


@pytest.mark.parametrize("family,name,body", TELLS)
def test_tells(family, name, body):
    assert docs.pair(body, name, family)[3]


@pytest.mark.parametrize("family,name,body", SILENT)
def test_silent(family, name, body):
    assert not docs.pair(body, name, family)[3]


def test_the_body_is_balanced_and_strings_are_protected():
    m = docs._pattern("braces").match('// Doc.\nfunction f(a) { if (a) { x = "}"; /* } */ } // }\n }\nrest')
    assert m.group("body").endswith("}") and "rest" not in m.group("body") and m.captures("com") == ["// Doc.\n"]


def test_pairs(spark):
    df = spark.createDataFrame([(1, "f", TELLS[0][2], None, "a.PY"), (1, "f", TELLS[0][2], None, "a.PY"), (2, None, None, None, None), (3, "f", "x" * 200_000, "go", None)], "function_id int, name string, body string, language string, file_path string")
    rows = docs.pairs(df).where("tells").collect()
    assert {(r.function_id, r.description) for r in rows} == {(1, "Keeps the newest entries.")}

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrykit.llm import provenance


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=4))
def test_grammars_expand_to_their_sequences(sequences):
    g = provenance.grammar(sequences)
    base = len(g.values)

    def expand(x):
        return [int(g.values[x])] if x < base else [z for y in (g.left[x - base], g.right[x - base]) for z in expand(y)]

    for i, s in enumerate(sequences):
        assert [z for x in g.rest[g.of == i].tolist() for z in expand(x)] == s
        alone = provenance.grammar([s])
        assert alone.size(1)[0] == g.size(len(sequences))[i] and sorted(alone.digest.tolist()) == sorted(g.digest[g.of == i].tolist())
    assert [len(expand(x)) for x in g.rest.tolist()] == g.length.tolist() and (g.uses >= 2).all()


def test_equal_stretches_end_in_equal_rules():
    rng = np.random.default_rng(1)
    a, common = rng.integers(0, 2**32, 400), rng.integers(0, 2**32, 600)
    h, size, of = provenance.long_rules(provenance.grammar([np.concatenate([a, common]), np.concatenate([common, a[:100]]), a, common]))
    both = set(h[of == 0].tolist()) & set(h[of == 1].tolist())
    assert sum(n for x, n in zip(h[of == 0].tolist(), size[of == 0].tolist()) if x in both) >= 450
    assert not set(h[of == 2].tolist()) & set(h[of == 3].tolist())


def test_reasons(spark):
    import random

    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    hand = lambda: "import os\n" + "\n".join(f"def {word()}({word()}, {word()}):\n    {rnd.choice(['return', 'yield', 'assert'])} {word()}{rnd.choice(['+', '-', '.x(', '['])}{word()} {rnd.choice('<>')} {rnd.randint(1, 99)}" for _ in range(14))
    copy = hand()
    blob = 'DATA = "' + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000)) + '"\n'
    rows = [
        ("r1", "a/hand.py", hand(), None), ("r1", "a/gen.py", "# Code generated by tool. DO NOT EDIT.\n" + hand(), "generated"), ("r1", "lib/copy.py", copy, "copied"), ("r2", "src/own.py", "# other head\n" + copy, "copied"),
        ("r1", "vendor/x/y.py", hand(), "copied"), ("r1", "a/blob.py", blob, "data"), ("r1", "web/app.js", "".join(f"function {word()}(a){{return a+{i}}}var {word()}={i};" for i in range(80)), "minified"),
        ("r1", "a/ids.java", "class A {\n" + "\n".join(f"  public static final int {word()} = {i};" for i in range(60)) + "\n}\n", "generated"), ("r1", "tools/generators/build.py", 'log("do not edit while running")\n' + hand(), None),
        ("r1", "a/empty.py", "", None), ("r1", None, None, None), (None, "a/levels.py", 'L = [\n  (0, "a b", 1),\n  (1, "c d", 2),\n]\n', None),
    ]
    rows.append(("r2", "a/banner.go", "// " + "free text of a licence. " * 200 + "\n// Code generated by maker. DO NOT EDIT.\n" + hand(), "generated"))  # a mark behind a long head
    df = spark.createDataFrame([(i, *r[:3], None, None) for i, r in enumerate(rows)] + [(0, *rows[0][:3], "Python", 7)], "file_id int, repo_url string, file_path string, source string, language string, size_bytes bigint")
    assert {r.id: r.reason for r in provenance.judged(df).collect()} == {i: r[3] for i, r in enumerate(rows)}

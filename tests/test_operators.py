from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import graph, rules, search, tables, timeline, tools
from quarrykit.sources import code, store


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_terms_never_split_camel_case(spark):
    assert column(spark, ["The getData_value of x1, é", None, ""], T.terms) == [["getdata", "value", "x1"], None, []]


def test_paths(spark):
    p = ["a/b/c.py", "c.py", "a/__init__.py", ".env"]
    assert column(spark, p, T.parent) == ["a/b", ".", "a", "."]
    assert column(spark, p, T.module) == ["a", "root", "a", "root"]
    assert column(spark, p, T.stem) == ["c", "c", "__init__", ".env"]
    assert column(spark, p[:3], T.module_names) == [["a.b.c", "b.c", "c"], ["c"], ["a"]]


def test_text_expressions(spark):
    assert column(spark, ["a/b.py::f", "b.py", None], T.short_name) == ["b.py::f", "b.py", None]
    assert column(spark, ["if a else b", "x ? y", None], T.complexity) == [3, 1, None]
    assert column(spark, ["a\n        b\n                \n", "", None], T.nesting) == [2, 0, 0]
    assert column(spark, ["x" * 79, " A\n\tb" * 40], T.fingerprint)[0] is None
    assert column(spark, [["self", "a: int = 3", " b ", "*args", ""]], T.clean_parameters, "array<string>") == [["a", "b", "*args"]]
    assert column(spark, ["how does it work", "getData", "foo bar", "however it may be used here"], T.is_keyword_query) == [False, True, True, False]


def test_one_per_key_and_counts(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 0, "q"), (None, 5, "r"), ("a", 0, "q")], "k string, o int, v string")
    assert {tuple(r) for r in tables.one_per_key(df, ["k"], ["o"]).collect()} == {("a", 0, "q"), (None, 5, "r")}
    got = {(r.dimension, r.value): r.n for r in tables.counts(df, "k", "v").collect()}
    assert got == {("k", "a"): 3, ("k", None): 1, ("v", "p"): 1, ("v", "q"): 2, ("v", "r"): 1}


SMELLS = [
    ('q = f"SELECT * FROM t WHERE a={a}"', "SQL Injection"), ('"x".format(SELECT)', "SQL Injection"), ("eval (x)", "Code Injection"), ("os.system('ls')", "Command Injection"), ("hashlib.MD5(x)", "Weak Hashing"),
    ("password = 'abc'", "Hardcoded Password"), ("verify = False", "SSL Verification Disabled"), ("DEBUG=True", "Debug Mode"), ("pickle.loads(b)", "Unsafe Deserialization"), ("yaml.load(f)", "Unsafe YAML Loading"),
    ("logger.log(password)", "Credential Logging"),
]


def test_each_smell_and_its_near_miss(spark):
    df = spark.createDataFrame([(i, f"ok\n{line}\n{line}") for i, (line, _) in enumerate(SMELLS)] + [(99, "yaml.load(f, Loader=SafeLoader)\nevaluate\nverify = True"), (100, None)], "i int, t string")
    got = {(r.i, r.line, r.label) for r in rules.scan(df, ["i"], "t", rules.SECURITY).collect()}
    for i, (_, label) in enumerate(SMELLS):
        assert (i, 2, label) in got and (i, 3, label) in got
    assert not [g for g in got if g[0] >= 99]


def test_endpoints_and_models(spark):
    text = '@app.get("/a")\nrouter.post(\'/b\', h)\n@bp.route("/c", methods=["GET", "put"])\n@GetMapping("/d")\nclass User(Base):\n'
    df = spark.createDataFrame([("r", "f.py", text), ("r", "g.py", None)], "repo_url string, file_path string, source string")
    assert {(r.method, r.endpoint) for r in rules.endpoints(df).collect()} == {("GET", "/a"), ("POST", "/b"), ("GET", "/c"), ("PUT", "/c"), ("GET", "/d")}
    assert [(r.name, r.orm) for r in rules.models(df).collect()] == [("User", "SQLAlchemy")]


def test_models_refer_to_each_other(spark):
    text = 'class User(Base):\n    posts = relationship("Post")\n    key = Column(ForeignKey("org.id"))\n    odd = relationship("Nowhere")\n\nclass Post(Base):\n    pass\n\nclass Car(models.Model):\n    owner = models.ForeignKey(User, null=True)\n'
    df = spark.createDataFrame([("r", "f.py", text), ("r", "g.js", "const userSchema = new mongoose.Schema({ a: 1 })"), ("r", "h.py", None)], "repo_url string, file_path string, source string")
    assert {tuple(r)[2:] for r in rules.relations(df).collect()} == {("User", "relationship", "Post"), ("User", "foreign_key", "org.id"), ("Car", "ForeignKey", "User")}
    assert {(r.name, r.orm) for r in rules.models(df).collect()} >= {("userSchema", "Mongoose"), ("Car", "Django ORM")}


def test_vectors_of_several_lengths_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 2)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [2.0, 0.0]), (8, [None, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    asked = df.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = {(r.query_id, r.id, r["rank"]) for r in search.vector_top(df, asked, "id", "v", "q", "qv", 2).collect()}
    assert got == {(1, 1, 1), (1, 7, 2), (7, 1, 1), (7, 7, 2), (2, 2, 1), (2, 3, 2), (3, 3, 1), (3, 1, 2), (6, 6, 1)}


def test_hybrid_search_filters_after_the_ranking(spark):
    words = spark.createDataFrame([("q", f"w{i}", i, "a" if i % 2 else "b") for i in range(1, 9)], "query_id string, id string, rank int, kind string")
    asked = spark.createDataFrame([("q", "how does it work in here")], "query_id string, query string")
    got = [(r.id, r.score, r["rank"]) for r in search.hybrid(words, words.where("rank = 1"), asked, ["id"], 2, F.col("kind") == "a").orderBy("rank").collect()]
    assert got == [("w1", round(1.0 / 61, 6), 1), ("w3", round(0.4 / 63, 6), 2)]
    assert search.hybrid(words, words, asked, ["id"], 2, F.col("kind") == "none").count() == 0


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "cache cache queue"), (2, "queue"), (3, None)], "id int, text string")
    q = spark.createDataFrame([("q", "cache cache")], "qid string, query string")
    (row,) = search.bm25(docs, q, "id", "text", "qid", "query", 5).collect()
    avg = 4 / 3
    want = 2 * math.log((3 - 1 + 0.5) / (1 + 0.5) + 1) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert (row.id, row.rank) == (1, 1) and abs(row.score - want) < 1e-3


def test_bm25_of_a_batch_is_the_sql(spark, tmp_path, monkeypatch):
    import random

    from quarrykit.plans.search_queries import bm25_sql
    from tests.compare import spark_rows, sql_rows

    monkeypatch.setattr(search, "DOCS", 7)
    monkeypatch.setattr(search, "ASKED", 4)
    pick = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["the", "Cache", "é", "x", "_"]
    text = lambda n: None if pick.random() < 0.1 else " ".join(pick.choices(words, [1 / (i + 1) for i in range(len(words))], k=pick.randrange(n)))
    docs = [(None if i % 20 == 0 else i % 45, text(9)) for i in range(60)]  # ids repeated, with texts of equal and of other lengths
    asked = [(None if i % 9 == 0 else f"q{i % 12}", text(6)) for i in range(18)] + [("none", "zzz"), ("twice", "w1 w1 w2")]
    d, q = spark.createDataFrame(docs, "id int, text string").repartition(3), spark.createDataFrame(asked, "qid string, query string")
    d.write.parquet(f"{tmp_path}/d.parquet")
    q.write.parquet(f"{tmp_path}/a.parquet")
    for k in (1, 3, 100):
        sql = bm25_sql("(SELECT * FROM read_parquet('PATH/d.parquet/*.parquet'))", "id", "text", "(SELECT qid AS query_id, query FROM read_parquet('PATH/a.parquet/*.parquet'))", k).replace("PATH", str(tmp_path))
        (tmp_path / f"none{k}").mkdir()
        _, want = sql_rows(f"{tmp_path}/none{k}", sql)
        assert want and spark_rows(search.bm25_batch(d, q, "id", "text", "qid", "query", k)) == want
    assert search.bm25_batch(d, q.limit(0), "id", "text", "qid", "query", 3).count() == 0


def test_a_batch_of_questions_does_not_shuffle_its_pairs(spark, tmp_path):
    """600 documents of one sentence, of which 12 ask: 7,200 pairs."""
    from quarrykit.plans.search_queries import registry

    spark.range(1, 601).select(F.col("id").alias("doc_id"), F.lit("Shared cache of agents. More").alias("text")).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: {(x := stages.apply(i)).stageId(): x.shuffleWriteRecords() for stages in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(stages.size())}
    before = shuffled()
    rows = registry.queries["bm25_batch"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.id, r["rank"]) for r in rows) == [(50 * i, j, j) for i in range(1, 13) for j in range(1, 6)]
    assert 0 < sum(n for stage, n in shuffled().items() if stage not in before) < 3000


def test_fusion_adds_up_colliding_keys(spark):
    a = spark.createDataFrame([("q", "f:1", 1), ("q", "f:1", 2), ("q", "g:1", 3)], "query_id string, k string, rank int")
    got = {r.k: (r.score, r.sources) for r in search.fused({"v": a, "b": a.where("rank = 3")}, {"v": 0.6, "b": 0.4}, ["k"], 5).collect()}
    assert got["f:1"] == (round(0.6 / 61 + 0.6 / 62, 6), ["v"]) and got["g:1"] == (round(1.0 / 63, 6), ["b", "v"])


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 1), (1, 2), (6, 5), (None, 2)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src int, dst int")


def test_closure_levels_paths_cycles(spark):
    e = edges(spark)
    near = {(a, b) for a, b in EDGES if a and a != b}
    want = set(near)
    while True:
        more = want | {(a, d) for a, b in want for c, d in near if b == c}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in graph.closure(e).collect()} == want
    start = spark.createDataFrame([(1,)], "start int")
    assert {(r.node, r.level) for r in graph.levels(e, start, 2).collect()} == {(2, 1), (3, 2)}
    assert {tuple(r.path) for r in graph.paths(e, start, 3).collect()} == {(1, 2), (1, 2, 3), (1, 2, 3, 4)}
    every = spark.createDataFrame([(i,) for i in range(1, 7)], "start int")
    assert [tuple(r.path) for r in graph.paths(e, every, 4, close=True).collect()] == [(1, 2, 3)]


def brute_betweenness(nodes, pairs):
    from collections import deque

    def counts(s):
        dist, sigma, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            v = todo.popleft()
            for a, b in pairs:
                if a == v:
                    if b not in dist:
                        dist[b] = dist[v] + 1
                        todo.append(b)
                    if dist[b] == dist[v] + 1:
                        sigma[b] = sigma.get(b, 0) + sigma[v]
        return dist, sigma

    info = {s: counts(s) for s in nodes}
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        if t not in info[s][0]:
            continue
        for v in nodes:
            if v not in (s, t) and v in info[s][0] and t in info[v][0] and info[s][0][v] + info[v][0][t] == info[s][0][t]:
                out[v] += info[s][1][v] * info[v][1][t] / info[s][1][t]
    return {v: x / ((len(nodes) - 1) * (len(nodes) - 2)) for v, x in out.items()}


def test_ranks(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    rank = {r.id: r.rank for r in graph.pagerank(nodes, edges(spark), 10).collect()}
    assert len(rank) == 7 and abs(sum(rank.values()) - 1) < 1e-9
    got = {r.id: r.score for r in graph.betweenness(nodes, edges(spark)).collect()}
    want = brute_betweenness(list(range(1, 8)), {(a, b) for a, b in EDGES if a and a != b})
    assert got == pytest.approx(want)


def test_imports_resolve_by_longest_prefix(spark):
    files = spark.createDataFrame([("r", "pkg/a.py", "python", "from pkg.b import x\nimport os, pkg.b.c\nfrom . import b"), ("r", "pkg/b.py", "python", "import pkg.a"), ("r", "z.py", "python", None)], "repo_url string, file_path string, language string, source string")
    got = graph.resolve_imports(graph.imports(files, ["repo_url", "file_path"], "source"), files)
    assert {(r.src, r.dst) for r in got.collect()} == {("pkg/a.py", "pkg/b.py"), ("pkg/b.py", "pkg/a.py")}


def test_calls_flow_and_overwriting(spark):
    f = spark.createDataFrame([("r", "a.py", "f", 1, ["g: int"], "def f(g): return g() + h()"), ("r", "b.py", "g", 2, None, "def g(): g(); f()"), ("r", "c.py", "h", 3, [], None)], "repo_url string, file_path string, name string, function_id int, parameters array<string>, body string")
    called = graph.calls(f)
    assert {(r.src, r.dst) for r in called.collect()} == {("a.py::f", "b.py::g"), ("a.py::f", "c.py::h"), ("b.py::g", "a.py::f")}
    assert graph.data_flow(f, called).count() == 0
    back = called.select("repo_url", F.col("dst").alias("src"), F.col("src").alias("dst"))
    got = {(r.src, r.dst): r.type for r in graph.overwritten([("calls", called), ("back", back)]).collect()}
    assert got[("a.py::f", "b.py::g")] == "back" and got[("a.py::f", "c.py::h")] == "calls"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(1, 9)), min_size=1, max_size=12))
def test_fusion_does_not_depend_on_the_order_of_rows(spark, rows):
    make = lambda x: spark.createDataFrame([("q", k, r) for k, r in x], "query_id string, k string, rank int")
    run = lambda x: sorted(map(tuple, search.fused({"v": make(x)}, {"v": 1.0}, ["k"], 9).select("k", "score").collect()))
    assert run(rows) == run(rows[::-1])


def test_source_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/a.py").write_bytes(b"class A(B, c.D):\n    async def f(self, x=1):\n        return 1\n\ndef g(): pass\n# \xff\n")
    (tmp_path / "b.js").write_text("export function go(a, b) {\n  if (a) { return b }\n}\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "node_modules/x.js").write_text("function no() {}")
    (tmp_path / "README.md").write_text("hello")
    files = code.tree(spark, str(tmp_path))
    assert {(r.file_path, r.language) for r in files.collect()} == {("pkg/a.py", "python"), ("b.js", "javascript"), ("bad.py", "python")}
    found = code.declarations(files, "file_path", path="file_path")
    assert {(r.file_path, r.kind, r.name, r.start_line, r.end_line, tuple(r.parts)) for r in found.collect()} == {
        ("pkg/a.py", "class", "A", 1, 3, ("B", "c.D")), ("pkg/a.py", "function", "f", 2, 3, ("self", "x")), ("pkg/a.py", "function", "g", 5, 5, ()), ("b.js", "function", "go", 1, 3, ("a", "b")),
    }
    assert [r.name for r in code.configuration(spark, str(tmp_path)).collect()] == ["README.md"]
    renamed = files.withColumn("id", F.col("file_path"))
    rows = code.chunks(renamed, found.withColumnRenamed("file_path", "id"), "id").collect()
    assert sorted(r.chunk_type for r in rows) == ["class", "file", "file", "file", "function", "function", "function"]
    assert [r.content for r in rows if r.chunk_type == "class"] == ["# File: pkg/a.py\n# Class: A (bases: [B, c.D])\n# Methods: f"]


def test_declarations_agree_with_the_parser_of_python(spark):
    import ast
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/source_files.parquet").dropDuplicates(["file_id"]).where("file_path like '%.py' and source is not null")
    got = {}
    for r in code.declarations(df, "file_id", path="file_path").collect():
        got.setdefault(r.file_id, set()).add((r.kind, r.name, r.start_line, r.end_line, tuple(r.parts)))
    checked = 0
    for r in df.collect():
        try:
            found = ast.parse(re.sub(r"\r\n?", "\n", r.source))
        except (SyntaxError, ValueError):
            continue
        want = set()
        for n in ast.walk(found):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                want.add(("function", n.name, n.lineno, n.end_lineno, tuple(a.arg for a in n.args.args + n.args.kwonlyargs)))
            elif isinstance(n, ast.ClassDef):
                want.add(("class", n.name, n.lineno, n.end_lineno, tuple(map(ast.unparse, n.bases))))
        assert got.get(r.file_id, set()) == want
        checked += len(want)
    assert checked > 200


def test_declarations_by_braces_and_ends(spark):
    texts = [
        ("b.js", "javascript", "function go(a, b) {\n  if (a) { return b } else {\n  }\n}\nfunction one(x) { return x }\nasync function z(\n  p = 1,\n  q\n)\n{\n" + "  x\n" * 400 + "}\n"), ("c.go", None, "func (s *S) Load(x []int, y string) int {\n\treturn 1\n}\n"),
        ("d.rb", "Ruby", "class X\n  def f(a, b = 1)\n    1\n  end\n\n  def g\n    2\n  end\nend\n"), ("e.cs", "csharp", "class A\n{\n    public int P(int a, string b)\n    {\n        return a;\n    }\n}\n"), ("h.php", "php", "<?php\nfunction f($a) {\n return 1;\n"),
        ("n.py", "python", None), ("e.py", "python", ""), (None, None, "x"),
    ]
    got = {(r.k, r.name, r.start_line, r.end_line, tuple(r.parts)) for r in code.declarations(spark.createDataFrame(texts, "k string, language string, source string"), "k", path="k").collect()}
    assert got == {("b.js", "go", 1, 4, ("a", "b")), ("b.js", "one", 5, 5, ("x",)), ("b.js", "z", 6, 411, ("p", "q")), ("c.go", "Load", 1, 3, ("x", "y")), ("d.rb", "X", 1, 9, ()), ("d.rb", "f", 2, 4, ("a", "b")), ("d.rb", "g", 6, 8, ()), ("e.cs", "P", 3, 6, ("a", "b")), ("h.php", "f", 2, 3, ("$a",))}


def test_stores_and_tools(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "a", "x"), ("c2", "b", "y")], "collection string, id string, content string")
    store.save_collection(rows, str(tmp_path / "v"))
    store.save_collection(rows.where("collection = 'c1'").withColumn("content", F.lit("new")), str(tmp_path / "v"))
    assert {(r.collection, r.content) for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {("c1", "new"), ("c2", "y")}
    store.write_cache(rows, str(tmp_path / "c"))
    assert store.read_cache(spark, str(tmp_path / "c"), "id string", 3600).count() == 2
    store.report({"one": rows, "two": rows.limit(0)}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/index")).count() == 2
    files = spark.createDataFrame([("src/a.py", "python", 3), ("a", None, 1)], "file_path string, language string, line_count int")
    assert tools.run({"files": files}, "read_file", "A").collect()[0].file_path == "a"
    results = spark.createDataFrame([("j1", '{"tech_stack": {"a": 1}}'), ("j2", 'noise {"tech_stack": [2]} end'), ("j3", '{"tech_stack": null}'), ("j4", None)], "job_id string, result string")
    assert {(r.job_id, r.text) for r in tools.run({"results": results}, "get_analysis_section", "Tech").collect()} == {("j1", '{"a":1}'), ("j2", "[2]")}
    chunks = spark.createDataFrame([("1", "cache the parser", "a.py"), ("2", "other words", "b.py")], "id string, content string, file_path string")
    assert [r.id for r in tools.run({"chunks": chunks}, "search_code", "parser cache").collect()] == ["1"]
    assert store.drop_collection(spark, str(tmp_path / "v"), "c1") and not store.drop_collection(spark, str(tmp_path / "v"), "c1")
    assert {r.collection for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"c2"}
    with pytest.raises(ValueError, match="search_files"):
        tools.run({}, "nope", "")


def test_ages_are_whole_days(spark):
    import datetime as dt

    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12)), (2, dt.datetime(2024, 1, 3, 11)), (3, None)], "i int, ts timestamp")
    assert {r.i: r.age_days for r in timeline.with_age(df, "ts").collect()} == {1: 1, 2: 0, 3: None}

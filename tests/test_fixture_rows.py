"""Queries that find nothing in the small tables, on a code base made for them: rows on both sides."""

from __future__ import annotations

import pytest

from quarrykit.plans.catalog import registries
from tests.compare import spark_rows, sql_rows

QUERIES = {n: f for r in registries() for n, f in r.queries.items()}
SQL = {n: s for r in registries() for n, s in r.sql.items()}
FILES = {
    "pkg/a.py": "import os\nfrom pkg.b import thing\n\ndef run(helper):\n    import json\n    return helper(json)\n\nclass Child(Base, Mixin, metaclass=Meta):\n    pass\n\nclass Base:\n    pass\n",
    "pkg/b.py": "import pkg.c.deep\nfrom a import x\n\nclass Mixin(object):\n    def go(self): pass\n\nasync def load(url):\n    from x import y\n    return await fetch(url)\n\nwhile True:\n    pass\n",
    "pkg/c/__init__.py": "", "web/api_client.js": "import { q } from '../pkg/b'\nconst r = require('./util')\nrequests.get(url)\n", "web/util.js": "app.get(\"/x\", f)\n", "main.go": "import (\n\t\"pkg/c\"\n)\n",
    "gateway/service_repo.java": "import pkg.c;\n", ".gitignore": ".env\n", "big/long.py": "x = 1\n" * 600,
    **{f"crowd/f{i}.py": f"x = {i}\n" for i in range(23)},
}
BODY = "def copied(value):\n    total = 0\n    for item in value:\n        total += item * 2 if item else 3\n    return total + len(value)\n"
FUNCTIONS = [
    ("pkg/a.py", "run", ["helper: int"], FILES["pkg/a.py"][40:90]), ("pkg/b.py", "load", ["url", "*args"], "async def load(url):\n    return await fetch(url)\n"), ("web/util.js", "helper", ["run"], "function helper(run) { return run() + load(1) }"),
    ("crowd/f1.py", "copied", None, BODY), ("crowd/f2.py", "copied_too", [], BODY.replace("    ", "\t").upper()), ("big/long.py", "very_long", [], "def very_long():\n" + "    x()\n" * 120),
    *[("pkg/a.py", n, [], f"def {n}(): return 1") for n in ("go", "getOne", "getTwo", "getThree", "setUp")], ("pkg/b.py", "deep", list("abcdefgh"), "def deep(a):\n" + "".join("    " * i + f"if a > {i} and a or {i}:\n" for i in range(1, 9)) + "    " * 9 + "return a\n"),
    ("crowd/f3.py", "taker", ["copied: list = 1"], "def taker(copied):\n    return 1\n"),
    *[(f"crowd/f{i}.py", f"caller_{i}", [], f"def caller_{i}():\n    return run({i})\n") for i in range(7)],
]
NAMES = (
    "crowded_directories", "duplicate_bodies", "duplicate_bodies_whole", "late_imports", "longest_prefix_resolution", "file_dependencies", "module_interactions", "class_bases", "data_flow_edges", "knowledge_edges", "knowledge_nodes", "failure_modes",
    "architecture_patterns", "health_scores", "code_quality_scores", "complexity_score", "call_degrees", "call_reach", "call_dependents", "call_paths", "quality_report", "quality_report_score", "module_edge_types", "known_edges", "file_impact", "folder_tree", "importance_order", "complex_functions",
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("code"))
    ending = {"py": "python", "js": "javascript", "go": "go", "java": "java"}
    rows = [(50 + i, "https://h/r", p, ending.get(p.rsplit(".", 1)[-1]), t.count("\n"), len(t), t, t[:2000], i) for i, (p, t) in enumerate(FILES.items())]
    schema = "file_id long, repo_url string, file_path string, language string, line_count int, size_bytes long, source string, source_preview string, ord int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{out}/source_files.parquet")
    functions = [(100 + i, 1, "https://h/r", p, n, 1, 1 + b.count("\n"), a, b, "javascript" if p.endswith("js") else "python", i) for i, (p, n, a, b) in enumerate(FUNCTIONS)]
    functions.append((150, 1, "https://h/r", "crowd/f9.py", "asker", 1, 2, [], "def asker():\n    return helper(caller_1())\n", "python", 99))
    columns = "function_id long, file_id long, repo_url string, file_path string, name string, start_line int, end_line int, parameters array<string>, body string, language string, ord int"
    spark.createDataFrame(functions, columns).coalesce(1).write.parquet(f"{out}/code_functions.parquet")
    import hashlib

    name = "repo_" + hashlib.md5(b"https://h/r").hexdigest()[:12]
    chunks = [("1", name, "# File: docker-compose.yml\nservices:\n image: a\n build: b\n image: c\n password = \"abcd\"", "docker-compose.yml"), ("2", name, "redis pool", "deploy/.env"), ("3", name, ".env\n", ".gitignore")]
    spark.createDataFrame([(*c, "file", "unknown", 1, 2) for c in chunks], "id string, collection string, content string, file_path string, chunk_type string, language string, start_line int, end_line int").coalesce(1).write.parquet(f"{out}/code_chunks.parquet")
    # SQL reads files, Spark folders
    import glob
    import os
    import shutil

    flat = str(tmp_path_factory.mktemp("flat"))
    for table in ("source_files", "code_functions", "code_chunks"):
        shutil.copy(glob.glob(f"{out}/{table}.parquet/*.parquet")[0], os.path.join(flat, f"{table}.parquet"))
    return flat


@pytest.mark.parametrize("name", NAMES)
def test_rows_on_both_sides(spark, folder, name):
    names, want = sql_rows(folder, SQL[name])
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == names
    assert want and spark_rows(df) == want


def test_scores_by_hand(spark, folder):
    (h,) = QUERIES["health_scores"](spark, folder).collect()
    # quality: 10 - very long function 1.5 - a large file 0.3 - a crowded folder 1 - no documentation 0.5
    assert h.quality == 6.7 and h.time_to_understand == "~23 minutes"
    # a password in the configuration 1.5, no validation 1, no CORS 0.5; .env is ignored
    assert h.security == 7.0
    modes = {(r.location, r.mode) for r in QUERIES["failure_modes"](spark, folder).collect()}
    assert modes == {("pkg/a.py::run", "single point of failure"), ("pkg/b.py::load", "unhandled async error"), ("pkg/b.py", "endless loop"), ("web/api_client.js", "missing timeout")}
    assert {(r.src, r.dst) for r in QUERIES["class_bases"](spark, folder).collect()} == {("pkg/a.py::Child", "pkg/a.py::Base"), ("pkg/a.py::Child", "pkg/b.py::Mixin")}
    assert [r.pattern for r in QUERIES["architecture_patterns"](spark, folder).collect() if r.is_primary] == ["Microservices"]

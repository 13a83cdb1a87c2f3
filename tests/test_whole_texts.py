"""File detectors read whole texts: what stands behind the first 2,000 characters counts."""

from __future__ import annotations

import pytest

from quarrykit.plans import corpus_queries, rule_queries

FAR = '''
def get_user(i):
    import json
    return db.query("x").fetch(f.read())
try:
    far_helper(eval("1"))
except:
    raise
from os import *
# def old():
global a
far_key = "abc"
nums = [2345, 2346, 2347, 2348, 2349, 2350]
@app.get("/far")
class Far(Base):
logger.info(event, listener, publish)
'''
SCHEMA = "file_id long, repo_url string, file_path string, language string, line_count int, size_bytes long, source string, source_preview string, ord int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    text = "x\n" * 1000 + FAR
    spark.createDataFrame([(1, "r", "a.py", "python", 1017, len(text), text, text[:2000], 0)], SCHEMA).write.parquet(f"{out}/source_files.parquet")
    functions = [(7, 1, "r", "a.py", "far_helper", 1, 2, [], "def far_helper(x): return 1", "python", 0)]
    columns = "function_id long, file_id long, repo_url string, file_path string, name string, start_line int, end_line int, parameters array<string>, body string, language string, ord int"
    # one use in the second file, behind its preview
    more = "y\n" * 1000 + "far_helper(2)\n"
    spark.createDataFrame([(2, "r", "b.py", "python", 1001, len(more), more, more[:2000], 1)], SCHEMA).write.mode("append").parquet(f"{out}/source_files.parquet")
    spark.createDataFrame(functions, columns).write.parquet(f"{out}/code_functions.parquet")
    chunks = "id string, collection string, content string, file_path string, chunk_type string, language string"
    spark.createDataFrame([], chunks).write.parquet(f"{out}/code_chunks.parquet")  # no configuration
    return out


def rows(spark, folder, name):
    queries = rule_queries.registry.queries | corpus_queries.registry.queries
    return [r.asDict() for r in queries[name](spark, folder).collect()]


def test_scans_and_detectors(spark, folder):
    assert {(r["label"], r["line"]) for r in rows(spark, folder, "security_scan_whole")} >= {("Code Injection", 1006)}
    assert "Code Injection" in {r["label"] for r in rows(spark, folder, "security_scan_all")}
    assert "Code Injection" in {r["label"] for r in rows(spark, folder, "security_by_severity_whole")}
    assert {r["category"] for r in rows(spark, folder, "quality_issues_whole")} == {"broad handlers", "dead comments", "star import"}
    assert {r["category"] for r in rows(spark, folder, "quality_issue_counts_whole")} == {"broad handlers", "dead comments", "star import"}
    assert [r["issues"] for r in rows(spark, folder, "quality_score_whole")] == [3]
    assert [r["file_path"] for r in rows(spark, folder, "first_issue_per_file_whole")] == ["a.py"]
    assert [(r["file_id"], r["count"]) for r in rows(spark, folder, "magic_numbers")] == [(1, 6)]
    assert {r["type"] for r in rows(spark, folder, "performance_issues")} == {"memory_hog", "no_cache"}
    assert [r["endpoint"] for r in rows(spark, folder, "declared_endpoints") if r["framework"] == "FastAPI"] == ["/far"]
    assert [r["name"] for r in rows(spark, folder, "declared_models")] == ["Far"]


def test_names_and_signs(spark, folder):
    assert [r["name"] for r in rows(spark, folder, "string_literal_names_whole")] == ["far_key"]
    assert rows(spark, folder, "unused_functions_whole") == []
    assert [(r["file_id"], r["n"]) for r in rows(spark, folder, "late_imports_whole")] == [(1, 2)]
    (sign,) = rows(spark, folder, "production_signs_whole")
    assert sign["logging"] and sign["handling"] == 2 and sign["globals"] == 1
    assert rows(spark, folder, "health_scores_whole")[0]["production"] == 3
    assert rows(spark, folder, "architecture_signs_whole")[0]["is_event_driven"]


def test_a_long_file_does_not_use_up_the_stack(spark, folder):
    from quarrykit.operators import rules

    text = "def get_all():\n" + "    pass\n" * 200_000
    df = spark.createDataFrame([("r", "a.py", text), ("r", "b.py", text + "fetch()\n")], "repo_url string, file_path string, source string")
    none = spark.createDataFrame([], "repo_url string, file_path string, start_line int, body string")
    assert [(r.file_path, r.type) for r in rules.performance(df, none, "source").collect()] == [("b.py", "no_cache")]


def test_functions_are_read_whole(spark, tmp_path):
    head = "def f(a):\n" + "    step(a)\n" * 40
    columns = "function_id long, file_id long, repo_url string, file_path string, name string, start_line int, end_line int, parameters array<string>, body string, language string, ord int"
    bodies = [(1, head + "    return 1", "python"), (2, head + "    return 2", "Python"), (3, head + "    return  2", None), (4, 'def g(\n' + "    a,\n" * 60 + '):\n    """Tells."""', "PYTHON")]
    spark.createDataFrame([(i, 1, "r", "a.py", f"f{i}", 1, 2, [], b, lang, 0) for i, b, lang in bodies], columns).write.parquet(f"{tmp_path}/code_functions.parquet")
    assert [(r["copies"], r["names"]) for r in rows(spark, str(tmp_path), "duplicate_bodies_whole")] == [(2, ["f2", "f3"])]
    assert [(r["functions"], r["ratio"]) for r in rows(spark, str(tmp_path), "documented_ratio_whole")] == [(4, 0.25)]

"""Named queries with a text argument, for agents and interfaces: ``run(tables, name, argument)``."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import graph, search

Tables = Mapping[str, DataFrame]


def _best(df: DataFrame, column: str, wanted: str, n: int) -> DataFrame:
    """Exact matches first, then those that contain the text, in order of the column."""
    low, asked = F.lower(column), wanted.lower()
    return df.where(low.contains(asked)).orderBy((low != asked).cast("int"), column).limit(n)


def search_files(t: Tables, q: str) -> DataFrame:
    return _best(t["files"], "file_path", q, 15)


def read_file(t: Tables, q: str) -> DataFrame:
    return _best(t["files"], "file_path", q, 1)


def find_functions(t: Tables, q: str) -> DataFrame:
    return _best(t["functions"], "name", q, 15)


def read_function(t: Tables, q: str) -> DataFrame:
    return _best(t["functions"], "name", q.split("::")[-1], 1)


def trace_dependencies(t: Tables, q: str) -> DataFrame:
    """What depends on a file, two steps far."""
    start = t["dependencies"].where(F.col("dst").contains(q)).orderBy("dst").limit(1).select(F.col("dst").alias("start"))
    return graph.levels(t["dependencies"], start, 2, reverse=True)


def trace_flow(t: Tables, q: str) -> DataFrame:
    """Paths of calls from a function, or between two given as ``a -> b``, shortest first."""
    a, _, b = (x.strip() for x in q.partition("->"))
    start = t["calls"].where(F.col("src").endswith(f"::{a}")).orderBy("src").limit(1).select(F.col("src").alias("start"))
    rows = graph.paths(t["calls"], start, 8)
    rows = rows.where(F.element_at("path", -1).endswith(f"::{b}")) if b else rows
    return rows.orderBy(F.size("path"), "path").limit(10)


def module_info(t: Tables, q: str) -> DataFrame:
    rows = t["files"].withColumn("module", T.module(F.col("file_path"))).where(F.lower("module") == q.lower())
    return rows.groupBy("module").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.array_sort(F.collect_set("language")).alias("languages"))


# Short names of the sections of an analysis.
SECTIONS = {
    "overview": "repo_overview", "tech_stack": "tech_stack", "tech": "tech_stack", "modules": "modules", "security": "security_analysis", "production": "production_readiness", "health": "health_dashboard",
    "dependencies": "dependencies", "flow": "system_flow", "cost": "cost_analysis", "quality": "code_quality", "knowledge_graph": "knowledge_graph", "recommendations": "recommendations",
}


def get_analysis_section(t: Tables, q: str) -> DataFrame:
    """(job_id, section, text): a section of every job's result, by its name or a short name; jobs without it give no row."""
    key = SECTIONS.get(q.lower().strip(), q.lower().strip())
    value = F.try_variant_get(T.json_object(F.col("result")), f'$["{key}"]', "variant")
    rows = t["results"].select("job_id", F.lit(key).alias("section"), value.alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.is_variant_null("v")).select("job_id", "section", F.to_json("v").alias("text"))


def search_code(t: Tables, q: str) -> DataFrame:
    """The best four chunks for a question with the first 500 characters of each, the length of a snippet."""
    chunks = t["chunks"]
    asked = chunks.sparkSession.createDataFrame([("q", q)], "query_id string, query string")
    found = search.bm25(chunks, asked, "id", "content", "query_id", "query", 4)
    return found.join(chunks.select("id", "file_path", F.substring("content", 1, 500).alias("snippet")), "id").select("rank", "id", "file_path", "score", "snippet")


TOOLS: dict[str, Callable[[Tables, str], DataFrame]] = {
    "search_files": search_files, "read_file": read_file, "find_functions": find_functions, "read_function": read_function,
    "trace_dependencies": trace_dependencies, "trace_flow": trace_flow, "get_module_info": module_info, "get_analysis_section": get_analysis_section, "search_code": search_code,
}


def run(tables: Tables, name: str, argument: str) -> DataFrame:
    """The result of a tool; an unknown name is an error that lists the known ones."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](tables, argument)

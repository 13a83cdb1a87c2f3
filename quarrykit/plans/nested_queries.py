"""Problem 1: nested job records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators import nested, tools
from quarrykit.plans import Registry
from quarrykit.session import table

registry = Registry()


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """One row per job: the one that was made and completed last."""
    values = ["result", "agent_events", "repo_url", "branch", "status", "created_at", "completed_at"]
    return nested.latest(table(spark, d, "analysis_jobs"), ["job_id"], values, ["created_at", "completed_at"])


@registry.query("p1_found")
def found(spark: SparkSession, d: str) -> DataFrame:
    return nested.element_objects(jobs(spark, d), "job_id", ["result", "agent_events"]).select("job_id", "path", "parent_path")


@registry.query("p1_jobs")
def job_table(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d)
    value = F.try_parse_json(nested.json_text(F.col("result")))
    take = lambda path, kind: F.try_variant_get(value, path, kind)
    return rows.select(
        "job_id", "repo_url", "branch", "status", "created_at", "completed_at",
        take("$.current_phase", "string").alias("current_phase"), take("$.quick_stats.total_files", "bigint").alias("total_files"),
        take("$.health_dashboard.overall_score", "double").alias("overall_score"),
    )


def _flat(name: str, column: str, steps: list[str], fields: dict[str, str]) -> None:
    registry.query(name)(lambda spark, d: nested.flat_table(jobs(spark, d), "job_id", column, steps, fields))


_flat("p1_steps", "result", ["progress_steps"], {"phase": "string", "status": "string", "duration_ms": "bigint"})
_flat("p1_modules", "result", ["modules"], {"module": "string"})
_flat("p1_files", "result", ["modules", "files"], {"file_path": "string"})
_flat("p1_functions", "result", ["modules", "files", "functions"], {"name": "string", "lines": "bigint"})
_flat("p1_file_issues", "result", ["modules", "files", "issues"], {"issue": "string", "severity": "string"})
_flat("p1_dependency_nodes", "result", ["dependencies.nodes"], {"file": "string", "in_degree": "bigint"})
_flat("p1_dependency_edges", "result", ["dependencies.edges"], {"source": "string", "target": "string", "type": "string"})
_flat("p1_events", "agent_events", [""], {"agent": "string", "type": "string", "message": "string", "timestamp": "string"})
_flat("p1_event_attempts", "agent_events", ["", "data.attempts"], {"n": "bigint"})


@registry.query("p1_issues")
def issues(spark: SparkSession, d: str) -> DataFrame:
    """Every issue object, wherever in the record it lies."""
    rows = nested.element_objects(jobs(spark, d), "job_id", ["result", "agent_events"]).where(F.col("path").rlike(r"issues\[\d+\]$"))
    take = lambda k: F.try_variant_get("value", f"$.{k}", "string").alias(k)
    return rows.select("job_id", "path", "parent_path", take("issue"), take("severity"), take("fix"))


_SECTIONS = tuple(dict.fromkeys(tools.SECTIONS.values()))
_STORED = """WITH j AS (SELECT DISTINCT job_id, CASE WHEN json_valid(result) AND json_type(result) = 'VARCHAR' THEN json_extract_string(result, '$') ELSE result END AS t FROM analysis_jobs),
v AS (SELECT job_id, t FROM j WHERE json_valid(t) AND json_type(t) = 'OBJECT')"""


@registry.query("analysis_sections", f"""{_STORED} SELECT job_id, section FROM v, (SELECT unnest([{", ".join(f"'{s}'" for s in _SECTIONS)}]) AS section) WHERE coalesce(json_type(t, '$.' || section), 'NULL') <> 'NULL'""")
def analysis_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections that each job's result holds."""
    rows = nested.parsed(jobs(spark, d), "job_id", ["result"]).select(F.col("_q_key").alias("job_id"), F.col("_q_value").alias("v"))
    has = lambda s: F.try_variant_get("v", f"$.{s}", "variant")
    held = F.filter(F.array(*[F.when(has(s).isNotNull() & ~F.is_variant_null(has(s)), F.lit(s)) for s in _SECTIONS]), lambda x: x.isNotNull())
    return rows.select("job_id", F.explode(held).alias("section"))

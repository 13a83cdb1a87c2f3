"""The engine's logical tables from the given parquet tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrykit.plans import Registry
from quarrykit.session import table

PREVIEW, WHOLE = "source_preview", "source"


def files(spark: SparkSession, d: str, text: str = WHOLE) -> DataFrame:
    """Source files, each id once (repeated rows are equal), with their text or, as PREVIEW, the start of it.

    Only the columns that a query uses are read and moved.
    """
    return table(spark, d, "source_files").select("file_id", "repo_url", "file_path", "language", "line_count", "size_bytes", text, "ord").dropDuplicates(["file_id"])


def text_query(registry: Registry) -> Callable[[str, str], Callable]:
    """Registers f(spark, d, text) with its SQL as NAME and as NAME_whole: both read whole texts.

    The SQL is written with the column PREVIEW, which f can be called with as well.
    """

    def query(name: str, sql: str) -> Callable:
        def add(f: Callable) -> Callable:
            for n in (name, f"{name}_whole"):
                registry.query(n, sql.replace(PREVIEW, WHOLE))(lambda spark, d: f(spark, d, WHOLE))
            return f

        return add

    return query


def functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_functions").select("function_id", "file_id", "repo_url", "file_path", "name", "start_line", "end_line", "parameters", "body", "language", "ord")
    return rows.dropDuplicates(["function_id"])


def configuration(spark: SparkSession, d: str) -> DataFrame:
    """(collection, file_path, content): configuration files, each id once; they stand among the chunks, in no known language."""
    rows = table(spark, d, "code_chunks").where("chunk_type = 'file' and language = 'unknown'")
    return rows.select("id", "collection", "file_path", "content").dropDuplicates(["id"]).drop("id")


FILES = "(SELECT DISTINCT file_id, repo_url, file_path, language, line_count, size_bytes, source_preview, ord FROM source_files)"
FUNCTIONS = "(SELECT DISTINCT function_id, file_id, repo_url, file_path, name, start_line, end_line, parameters, body, language, ord FROM code_functions)"
CONFIGURATION = "(SELECT collection, any_value(file_path) AS file_path, any_value(content) AS content FROM code_chunks WHERE chunk_type = 'file' AND language = 'unknown' GROUP BY id, collection)"

"""Streams over the event table, declarations read from source texts, chunks, sections of reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans import Registry
from quarrykit.session import table
from quarrykit.sources import code
from quarrykit.streaming import events

registry = Registry()
query = registry.query


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return events.source(spark, os.path.join(d, "events.parquet"), "ts", "10 minutes")


@query("stream_tumbling", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", event_type, count(*) AS n FROM events GROUP BY ALL
HAVING time_bucket(INTERVAL '1 hour', any_value(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Rows per hour and type, of the hours that the watermark has closed."""
    out = events.drained(events.tumbling(_stream(spark, d), "ts", "1 hour", "event_type"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("stream_sessions", """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", count(*) AS n FROM g GROUP BY user_id, g)
SELECT user_id, start, "end", n FROM s WHERE "end" <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with pauses under two hours, of those that the watermark has closed."""
    out = events.drained(events.sessions(_stream(spark, d), "ts", "2 hours", "user_id"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("stream_distinct", "SELECT DISTINCT event_id, event_type FROM events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    return events.drained(events.distinct_events(_stream(spark, d), "event_id").select("event_id", "event_type"))


@query("batch_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def batch_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.tumbling(rows, "ts", "1 day", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", "file_path", "language", "source").dropDuplicates(["file_id"])


@query("parsed_declarations")
def parsed_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Functions and classes read from the texts of all files."""
    return code.declarations(_sources(spark, d), "file_id", path="file_path")


@query("built_chunks")
def built_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d)
    return code.chunks(rows, code.declarations(rows, "file_id", path="file_path"), "file_id")


@query("report_sections", """
WITH f AS (SELECT DISTINCT file_id, repo_url, language FROM source_files) SELECT repo_url, 'languages' AS section, count(*) AS rows FROM (SELECT DISTINCT repo_url, language FROM f) GROUP BY repo_url
UNION ALL SELECT repo_url, 'files', count(*) FROM f GROUP BY repo_url""")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each repository's report with their number of rows."""
    f = table(spark, d, "source_files").select("file_id", "repo_url", "language").distinct()
    own = f.groupBy("repo_url").agg(F.count("*").alias("files"), (F.countDistinct("language") + F.max(F.col("language").isNull().cast("int"))).alias("languages"))
    return own.select("repo_url", F.stack(F.lit(2), F.lit("files"), F.col("files"), F.lit("languages"), F.col("languages")).alias("section", "rows"))

"""Change history on the event table: authors are users, modules are event types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators import nested, tables, timeline
from quarrykit.plans import Registry
from quarrykit.session import table

registry = Registry()
query = registry.query


def changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("author"), F.col("event_type").alias("module"), F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("file"), "value")
    return timeline.with_age(rows, "ts")


CHANGES = """(SELECT event_id, ts, user_id AS author, event_type AS module, event_type || '/' || json_extract_string(props, '$.k') AS file, value,
 ((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 86400000000)::INTEGER AS age_days FROM events)"""


@query("active_modules", f"SELECT module, count(*) AS changes, count(*) FILTER (age_days <= 7) AS recent, count(DISTINCT file) AS files FROM {CHANGES} GROUP BY module")
def active_modules(spark: SparkSession, d: str) -> DataFrame:
    return timeline.active_modules(changes(spark, d), "module", "file", 7)


@query("abandoned_files", f"SELECT file, min(age_days) AS last_days, count(*) AS changes FROM {CHANGES} GROUP BY file HAVING min(age_days) > 1")
def abandoned_files(spark: SparkSession, d: str) -> DataFrame:
    return timeline.abandoned(changes(spark, d), "file", 1)


@query("change_hot_spots", f"SELECT file, count(*) AS changes, count(DISTINCT author) AS authors FROM {CHANGES} GROUP BY file ORDER BY changes DESC, file LIMIT 15")
def change_hot_spots(spark: SparkSession, d: str) -> DataFrame:
    return timeline.hot_spots(changes(spark, d), "file", "author", 15)


@query("commit_velocity", f"""
WITH c AS (SELECT (age_days // 7)::INTEGER AS week, count(*) AS n FROM {CHANGES} WHERE age_days >= 0 AND age_days < 84 GROUP BY week),
w AS (SELECT r.week::INTEGER AS week, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(12)) AS week) r LEFT JOIN c ON c.week = r.week),
t AS (SELECT sum(n) FILTER (week <= 3) AS late, sum(n) FILTER (week BETWEEN 4 AND 7) AS early, round(avg(n) FILTER (n > 0), 4) AS mean FROM w)
SELECT week, n, mean AS mean_of_busy_weeks, CASE WHEN late > early * 1.2 THEN 'increasing' WHEN late < early * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM w, t""")
def commit_velocity(spark: SparkSession, d: str) -> DataFrame:
    return timeline.velocity(changes(spark, d))


@query("contributors", f"""
WITH a AS (SELECT author, count(*) AS commits FROM {CHANGES} GROUP BY author ORDER BY commits DESC, author LIMIT 10),
s AS (SELECT author, commits, round(commits * 100.0::DOUBLE / (SELECT count(*) FROM {CHANGES}), 1) AS share FROM a),
r AS (SELECT *, round(sum(share) OVER (ORDER BY commits DESC, author ROWS UNBOUNDED PRECEDING), 1) AS running FROM s)
SELECT author, commits, share, running, round(running - share, 1) < 80 AS in_bus_factor FROM r""")
def contributors(spark: SparkSession, d: str) -> DataFrame:
    return timeline.contributors(changes(spark, d), "author")


@query("bus_factor", f"""
WITH a AS (SELECT author, count(*) AS commits FROM {CHANGES} GROUP BY author ORDER BY commits DESC, author LIMIT 10),
s AS (SELECT author, commits, round(commits * 100.0::DOUBLE / (SELECT count(*) FROM {CHANGES}), 1) AS share FROM a),
r AS (SELECT *, round(sum(share) OVER (ORDER BY commits DESC, author ROWS UNBOUNDED PRECEDING), 1) AS running FROM s)
SELECT count(*) FILTER (round(running - share, 1) < 80) AS bus_factor, (SELECT count(DISTINCT author) FROM {CHANGES}) AS authors FROM r""")
def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    rows = changes(spark, d)
    own = timeline.contributors(rows, "author").agg(F.count_if("in_bus_factor").alias("bus_factor"))
    return own.join(rows.agg(F.countDistinct("author").alias("authors")), F.lit(True))


_DAYS = "((epoch_us(b) - epoch_us(a)) // 86400000000)"


@query("time_span", f"""
WITH s AS (SELECT module, min(ts) AS a, max(ts) AS b, count(*) AS n FROM {CHANGES} GROUP BY module)
SELECT module, n, CASE WHEN {_DAYS} > 365 THEN ({_DAYS} // 365) || 'y ' || (({_DAYS} % 365) // 30) || 'm' ELSE {_DAYS} || ' days' END AS span FROM s""")
def time_span(spark: SparkSession, d: str) -> DataFrame:
    s = changes(spark, d).groupBy("module").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return s.select("module", "n", timeline.span(F.col("a"), F.col("b")).alias("span"))


@query("weekly_modules", f"SELECT module, (age_days // 7)::INTEGER AS week, count(*) AS n, round(sum(value), 4) AS value FROM {CHANGES} GROUP BY ALL")
def weekly_modules(spark: SparkSession, d: str) -> DataFrame:
    return changes(spark, d).groupBy("module", F.floor(F.col("age_days") / 7).cast("int").alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("newest_changes", f"SELECT event_id, module, age_days FROM {CHANGES} ORDER BY ts DESC, event_id LIMIT 20")
def newest_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes(spark, d).orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "module", "age_days")


_JOBS = "(SELECT DISTINCT job_id, repo_url, branch, status, created_at, completed_at FROM analysis_jobs)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analysis_jobs").select("job_id", "repo_url", "branch", "status", "created_at", "completed_at").distinct()


@query("latest_job_per_repo", f"SELECT repo_url, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY created_at DESC, job_id DESC) AS r FROM {_JOBS}) WHERE r = 1")
def latest_job_per_repo(spark: SparkSession, d: str) -> DataFrame:
    return tables.one_per_key(jobs(spark, d).select("repo_url", "created_at", "job_id", "status"), ["repo_url"], ["created_at", "job_id"], last=True).select("repo_url", "job_id", "status")


@query("jobs_in_flight", f"""
SELECT repo_url, count(*) AS active, max(created_at) AS newest FROM {_JOBS} WHERE status NOT IN ('completed', 'failed') GROUP BY repo_url""")
def jobs_in_flight(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where(~F.col("status").isin("completed", "failed")).groupBy("repo_url").agg(F.count("*").alias("active"), F.max("created_at").alias("newest"))


_STEP = """WITH j AS (SELECT DISTINCT job_id, CASE WHEN json_valid(result) AND json_type(result) = 'VARCHAR' THEN json_extract_string(result, '$') ELSE result END AS t FROM analysis_jobs),
v AS (SELECT job_id, t FROM j WHERE json_valid(t) AND json_type(t) = 'OBJECT' AND json_type(t, '$.progress_steps') = 'ARRAY'),
s AS (SELECT job_id, unnest(json_extract(t, '$.progress_steps[*]')) AS x FROM v)"""


@query("job_progress", f"""{_STEP}
SELECT job_id, count(*) AS steps, count(*) FILTER (json_extract_string(x, '$.status') = 'done') AS done, count(*) FILTER (json_extract_string(x, '$.status') = 'failed') AS failed,
 round(100.0 * count(*) FILTER (json_extract_string(x, '$.status') = 'done') / count(*), 1)::DOUBLE AS percent FROM s WHERE json_type(x) = 'OBJECT' GROUP BY job_id""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    from quarrykit.plans.nested_queries import jobs as latest

    steps = nested.flat_table(latest(spark, d), "job_id", "result", ["progress_steps"], {"status": "string"})
    rows = steps.groupBy("job_id").agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    return rows.withColumn("percent", F.round(F.col("done") * 100.0 / F.col("steps"), 1))


@query("agent_status", """
WITH j AS (SELECT DISTINCT job_id, CASE WHEN json_valid(agent_events) AND json_type(agent_events) = 'VARCHAR' THEN json_extract_string(agent_events, '$') ELSE agent_events END AS t FROM analysis_jobs),
v AS (SELECT job_id, json_extract(t, '$[*]') AS xs FROM j WHERE json_valid(t) AND json_type(t) = 'ARRAY'),
s AS (SELECT job_id, generate_subscripts(xs, 1) AS pos, unnest(xs) AS x FROM v), o AS (SELECT job_id, pos, json_extract_string(x, '$.agent') AS agent, json_extract_string(x, '$.type') AS status FROM s WHERE json_type(x) = 'OBJECT')
SELECT job_id, agent, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id, agent ORDER BY pos DESC) AS r FROM o WHERE agent IS NOT NULL) WHERE r = 1""")
def agent_status(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every agent of every job."""
    from quarrykit.plans.nested_queries import jobs as latest

    rows = nested.flat_table(latest(spark, d), "job_id", "agent_events", [""], {"agent": "string", "type": "string"})
    rows = rows.where("agent is not null").select("job_id", "agent", F.regexp_extract("path", r"(\d+)\]$", 1).cast("int").alias("pos"), F.col("type").alias("status"))
    return tables.one_per_key(rows, ["job_id", "agent"], ["pos"], last=True).select("job_id", "agent", "status")


@query("replay_since", "SELECT event_id, event_type, user_id FROM events WHERE event_id > (SELECT max(event_id) - 100 FROM events)")
def replay_since(spark: SparkSession, d: str) -> DataFrame:
    """Events behind an offset."""
    rows = table(spark, d, "events")
    return rows.join(F.broadcast(rows.agg((F.max("event_id") - 100).alias("since"))), F.col("event_id") > F.col("since")).select("event_id", "event_type", "user_id")


@query("state_of_keys", """
SELECT event_type || '.' || user_id AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE starts_with(event_type, 'p')) WHERE r = 1""")
def state_of_keys(spark: SparkSession, d: str) -> DataFrame:
    """Latest value of each key of a section of the shared state."""
    rows = table(spark, d, "events").where(F.col("event_type").startswith("p")).select("event_type", "user_id", "ts", "event_id", "value")
    last = tables.one_per_key(rows, ["event_type", "user_id"], ["ts", "event_id"], last=True)
    return last.select(F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("key"), "value")


@query("cache_with_expiry", "SELECT event_id, user_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 3600::BIGINT * 1000000 * 24")
def cache_with_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Entries not older than a day against the newest."""
    rows = table(spark, d, "events")
    now = F.broadcast(rows.agg(F.max("ts").alias("now")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.join(now, F.lit(True)).where(micros("now") - micros("ts") <= 86_400_000_000).select("event_id", "user_id")

"""Rule scans, detectors and scores, per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import graph, rules, scores, tables
from quarrykit.plans import Registry
from quarrykit.plans.corpus_queries import LATE, PARENT, UNUSED, late_imports, sql_any, sql_count, unused_functions
from quarrykit.plans.data import CONFIGURATION, FILES, FUNCTIONS, WHOLE, configuration, files, functions, text_query
from quarrykit.plans.graph_queries import CALLS, DEPENDENCIES, dependencies

registry = Registry()
query = registry.query
of_texts = text_query(registry)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql(table: str, keys: str, text: str, found: tuple[rules.Rule, ...]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keys}, line, {i} AS rule, {_quoted(r.label)} AS label, {_quoted(r.severity)} AS severity, {_quoted(r.issue)} AS issue, {_quoted(r.fix)} AS fix, "
        f"substr(regexp_extract(content, {_quoted('(?i)' + r.pattern)}), 1, 80) AS match FROM l WHERE regexp_matches(content, {_quoted('(?i)' + r.pattern)})"
        for i, r in enumerate(found)
    )
    return f"""
WITH l AS (SELECT {keys}, generate_subscripts(string_split({text}, chr(10)), 1)::INTEGER AS line, unnest(string_split({text}, chr(10))) AS content FROM {table}), h AS ({parts})
SELECT {keys}, line, label, severity, issue, fix, match FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, label, line ORDER BY rule) AS r FROM h) WHERE r = 1"""


_PLAIN = tuple(r for r in rules.SECURITY if r.sql)


@of_texts("security_scan", scan_sql(FILES, "file_id", "source_preview", _PLAIN))
def security_scan(spark: SparkSession, d: str, text: str) -> DataFrame:
    return rules.scan(files(spark, d, text), ["file_id"], text, _PLAIN)


@query("security_scan_all")
def security_scan_all(spark: SparkSession, d: str) -> DataFrame:
    """Over whole texts, with the rule that looks ahead, which SQL cannot express."""
    return rules.scan(files(spark, d, WHOLE), ["file_id"], WHOLE, rules.SECURITY)


@query("security_scan_bodies", scan_sql(FUNCTIONS, "function_id", "body", _PLAIN))
def security_scan_bodies(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(functions(spark, d), ["function_id"], "body", _PLAIN)


@of_texts("security_by_severity", f"SELECT severity, label, count(*) AS n FROM ({scan_sql(FILES, 'file_id', 'source_preview', _PLAIN)}) GROUP BY ALL")
def security_by_severity(spark: SparkSession, d: str, text: str) -> DataFrame:
    return rules.scan(files(spark, d, text), ["file_id"], text, _PLAIN).groupBy("severity", "label").agg(F.count("*").alias("n"))


@query("secret_scan", scan_sql("documents", "doc_id", "text", rules.SECRETS))
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    from quarrykit.session import table

    return rules.scan(table(spark, d, "documents"), ["doc_id"], "text", rules.SECRETS)


_ISSUE = "SELECT repo_url, file_path, {line}::INTEGER AS line, '{category}' AS category, {severity} AS severity, {subject} AS subject FROM {table} WHERE {where}"
_TRIM = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


def quality_sql(x: dict[str, int]) -> str:
    """Issues of structure at some limits."""
    return f"""
WITH f AS (SELECT repo_url, file_path, start_line AS place, name, {sql_count('body', T.DECISIONS)} AS cc, coalesce(len(parameters), 0) AS params, length(name) AS len, function_id FROM {FUNCTIONS}),
nl AS (SELECT function_id, unnest(string_split(body, chr(10))) AS x FROM {FUNCTIONS}),
nest AS (SELECT function_id, (max(CASE WHEN regexp_matches(x, '\\S') THEN length(x) - length(regexp_replace(x, '^\\s+', '')) ELSE 0 END) // 4) AS deep FROM nl GROUP BY function_id),
g AS (SELECT f.*, nest.deep FROM f JOIN nest USING (function_id)),
n AS (SELECT repo_url, file_path, count(*) AS n FROM {FUNCTIONS} GROUP BY ALL),
s AS (SELECT *, len(regexp_extract_all(source_preview, '\\bexcept\\s*:')) + len(regexp_extract_all(source_preview, '\\bexcept\\s+Exception\\s*:')) AS broad,
  len(list_filter(list_transform(string_split(source_preview, chr(10)), lambda x: {_TRIM}), lambda x: (starts_with(x, '#') OR starts_with(x, '//')) AND {sql_any('x', rules.CODE_WORDS)})) AS dead FROM {FILES})
{_ISSUE.format(line='place', category='complexity', severity="CASE WHEN cc > %d THEN 'critical' WHEN cc > %d THEN 'high' ELSE 'medium' END" % (x['worst'], x['high']), subject='name', table='g', where=f"cc > {x['medium']}")} UNION ALL
{_ISSUE.format(line='place', category='nesting', severity="'medium'", subject='name', table='g', where=f"deep >= {x['deep']}")} UNION ALL
{_ISSUE.format(line='place', category='naming', severity="'low'", subject='name', table='g', where=f"len > {x['name']}")} UNION ALL
{_ISSUE.format(line='place', category='parameters', severity="'medium'", subject='name', table='g', where=f"params > {x['params']}")} UNION ALL
{_ISSUE.format(line='NULL', category='module size', severity=f"CASE WHEN n > {x['large']} THEN 'high' ELSE 'medium' END", subject='file_path', table='n', where=f"n > {x['module']}")} UNION ALL
{_ISSUE.format(line='NULL', category='broad handlers', severity="'medium'", subject='file_path', table='s', where=f"broad >= {x['broad']}")} UNION ALL
{_ISSUE.format(line='NULL', category='dead comments', severity="'low'", subject='file_path', table='s', where=f"dead >= {x['dead']}")} UNION ALL
{_ISSUE.format(line='NULL', category='star import', severity="'medium'", subject='file_path', table='s', where="language = 'python' AND regexp_matches(source_preview, 'from\\s+\\S+\\s+import\\s+\\*')")}"""


QUALITY, QUALITY_AT_LIMITS = quality_sql(rules.TIGHT), quality_sql(rules.LIMITS)


@of_texts("quality_issues", QUALITY)
def quality_issues(spark: SparkSession, d: str, text: str) -> DataFrame:
    return rules.quality(files(spark, d, text), functions(spark, d), rules.TIGHT, text)


@of_texts("quality_issue_counts", f"SELECT category, severity, count(*) AS n, count(DISTINCT repo_url) AS repos FROM ({QUALITY}) GROUP BY ALL")
def quality_issue_counts(spark: SparkSession, d: str, text: str) -> DataFrame:
    return rules.quality(files(spark, d, text), functions(spark, d), rules.TIGHT, text).groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("repo_url").alias("repos"))


@of_texts("quality_score", f"""
SELECT repo_url, count(*) AS issues, round(greatest(0, least(10, 10 - sum(CASE severity WHEN 'critical' THEN 1.5 WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.2 END)))::DOUBLE, 1) AS score FROM ({QUALITY}) GROUP BY repo_url""")
def quality_score(spark: SparkSession, d: str, text: str) -> DataFrame:
    return rules.penalised(rules.quality(files(spark, d, text), functions(spark, d), rules.TIGHT, text), "repo_url")


@of_texts("first_issue_per_file", f"""
SELECT file_path, repo_url, category, severity FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, file_path ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, category) AS r FROM ({QUALITY})) WHERE r = 1""")
def first_issue_per_file(spark: SparkSession, d: str, text: str) -> DataFrame:
    rows = rules.quality(files(spark, d, text), functions(spark, d), rules.TIGHT, text).withColumn("rank", T.severity_rank(F.col("severity"))).select("repo_url", "file_path", "rank", "category", "severity")
    return tables.one_per_key(rows, ["repo_url", "file_path"], ["rank", "category"]).select("file_path", "repo_url", "category", "severity")


_R = rules.REPORT
_FLAT = "regexp_replace(lower(regexp_replace(body, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')"
HABITS = f"""
SELECT repo_url, file_path, start_line::INTEGER AS line, 'short name' AS category, 'low' AS severity, name AS subject FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, language ORDER BY function_id) AS r FROM {FUNCTIONS} WHERE length(name) <= 2 AND name NOT IN ('_', '__')) WHERE r <= {_R['short']} UNION ALL
SELECT repo_url, file_path, NULL, 'camel case', 'low', n::VARCHAR FROM (SELECT repo_url, count(*) AS n, arg_min(file_path, function_id) AS file_path FROM {FUNCTIONS} WHERE language = 'python' AND regexp_matches(name, '^[a-z][a-zA-Z]+$') AND regexp_matches(name, '[A-Z]') AND name NOT IN ({", ".join(f"'{n}'" for n in rules.ASKED_FOR)}) GROUP BY repo_url) WHERE n >= {_R['camel']} UNION ALL
SELECT repo_url, file_path, line::INTEGER, 'duplication', CASE WHEN lines > {_R['lines']} THEN 'high' ELSE 'medium' END, name FROM (SELECT repo_url, count(*) AS copies, sum(n) - arg_min(n, function_id) AS lines, arg_min(file_path, function_id) AS file_path, arg_min(start_line, function_id) AS line, arg_min(name, function_id) AS name
  FROM (SELECT *, substr({_FLAT}, 1, 200) AS fp, len(string_split(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), chr(10))) AS n FROM {FUNCTIONS} WHERE length({_FLAT}) >= 80) GROUP BY repo_url, fp) WHERE copies >= 2 UNION ALL
SELECT repo_url, file_path, NULL, 'dead code', CASE WHEN n > {_R['much']} THEN 'medium' ELSE 'low' END, n::VARCHAR FROM (SELECT u.repo_url, count(*) AS n, arg_min(f.file_path, u.function_id) AS file_path FROM ({UNUSED}) u JOIN {FUNCTIONS} f USING (function_id) GROUP BY u.repo_url) WHERE n >= {_R['unused']} UNION ALL
SELECT repo_url, file_path, NULL, 'late imports', 'medium', n::VARCHAR FROM ({LATE}) JOIN {FILES} USING (file_id) WHERE n >= {_R['late']}"""
REPORT = f"SELECT * FROM ({QUALITY_AT_LIMITS}) UNION ALL SELECT * FROM ({HABITS})"


def _report(spark: SparkSession, d: str, text: str) -> DataFrame:
    f = files(spark, d, text)
    late = late_imports(spark, d, text).join(f.select("file_id", "repo_url", "file_path"), "file_id")
    return rules.quality(f, functions(spark, d), rules.LIMITS, text).unionByName(rules.habits(functions(spark, d), unused_functions(spark, d, text), late))


@of_texts("quality_report", REPORT)
def quality_report(spark: SparkSession, d: str, text: str) -> DataFrame:
    """All issues of quality at the limits of the blueprint, of functions, files and whole repositories."""
    return _report(spark, d, text)


@of_texts("quality_report_score", f"""
SELECT repo_url, count(*) AS issues, round(greatest(0, least(10, 10 - sum(CASE severity WHEN 'critical' THEN 1.5 WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.2 END)))::DOUBLE, 1) AS score FROM ({REPORT}) GROUP BY repo_url""")
def quality_report_score(spark: SparkSession, d: str, text: str) -> DataFrame:
    return rules.penalised(_report(spark, d, text), "repo_url")


@query("magic_numbers")
def magic_numbers(spark: SparkSession, d: str) -> DataFrame:
    return rules.magic_numbers(files(spark, d, WHOLE), ["file_id"], WHOLE)


_LOOPS = "len(regexp_extract_all(body, '\\bfor\\b')) + len(regexp_extract_all(body, '\\bwhile\\b'))"


@query("heavy_loops", f"SELECT DISTINCT repo_url, file_path, start_line AS line, CASE WHEN {_LOOPS} > 3 THEN 'high' ELSE 'medium' END AS severity FROM {FUNCTIONS} WHERE {_LOOPS} >= 3")
def heavy_loops(spark: SparkSession, d: str) -> DataFrame:
    return rules.performance(files(spark, d), functions(spark, d)).where("type = 'heavy_loop'").select("repo_url", "file_path", "line", "severity").distinct()


@query("performance_issues")
def performance_issues(spark: SparkSession, d: str) -> DataFrame:
    return rules.performance(files(spark, d, WHOLE), functions(spark, d), WHOLE)


@query("declared_endpoints")
def declared_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return rules.endpoints(files(spark, d, WHOLE), WHOLE)


@query("declared_models")
def declared_models(spark: SparkSession, d: str) -> DataFrame:
    return rules.models(files(spark, d, WHOLE), WHOLE)


@query("model_relations")
def model_relations(spark: SparkSession, d: str) -> DataFrame:
    return rules.relations(files(spark, d, WHOLE), WHOLE)


@of_texts("string_literal_names", """
SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(source_preview, '([A-Za-z_]+)\\s*=\\s*["''][^"'']*["'']', 1)) AS name FROM (SELECT DISTINCT file_id, source_preview FROM source_files)) GROUP BY name""")
def string_literal_names(spark: SparkSession, d: str, text: str) -> DataFrame:
    names = F.regexp_extract_all(text, F.lit(r"""([A-Za-z_]+)\s*=\s*["'][^"']*["']"""), F.lit(1))
    return files(spark, d, text).select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def _signs_sql() -> str:
    p = "source_preview"
    cols = [f"coalesce(bool_or({sql_any(p, v)}), false) AS {k}" for k, v in scores.SIGNS.items()] + [f"coalesce(bool_or({sql_any(f'lower({p})', v)}), false) AS {k}" for k, v in scores.LOW_SIGNS.items()]
    cols += ["(" + " + ".join(f"coalesce(bool_or(contains({p}, '{h}')), false)::INTEGER" for h in scores.HANDLING) + ") AS handling"]
    cols += [f"(" + " + ".join(f"coalesce(bool_or(regexp_matches({p}, {_quoted('(?i)' + r.pattern)})), false)::INTEGER" for r in rules.SECRETS) + ") AS secrets"]
    cols += ["(" + " OR ".join(f"coalesce(bool_or(regexp_matches({p}, {_quoted('(?i)' + r)})), false)" for r in scores.RAW_SQL) + ") AS raw_sql"]
    cols += [f"coalesce(sum((length({p}) - length(replace({p}, 'global ', ''))) // 7 + (length({p}) - length(replace({p}, '_instance = None', ''))) // 16), 0)::BIGINT AS globals"]
    cols += ["count(*) FILTER (contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec')) AS tests", "count(*) AS files"]
    return f"SELECT repo_url, {', '.join(cols)} FROM {FILES} GROUP BY repo_url"


@of_texts("production_signs", _signs_sql())
def production_signs(spark: SparkSession, d: str, text: str) -> DataFrame:
    return scores.signs(files(spark, d, text), text)


_C = "lower(content)"
_P = "file_path"
_CONFIG_SQL = f"""SELECT collection, bool_or({sql_any(_P, scores.SIGNS['config'])}) AS c_config, bool_or({sql_any('lower(file_path)', ('dockerfile', 'docker-compose'))}) AS c_docker, bool_or(contains(lower(file_path), 'docker')) AS c_contained,
 bool_or({sql_any(_P, scores.PIPELINES)}) AS c_pipeline, bool_or(ends_with('/' || file_path, '/.gitignore') AND contains(content, '.env')) AS c_ignored, bool_or(contains(file_path, '.env')) AS c_env,
 {", ".join(f"bool_or({sql_any(_C, scores.LOW_SIGNS[k])}) AS c_{k}" for k in ("caching", "pooling", "queues"))},
 ({" + ".join(f"coalesce(bool_or(regexp_matches(content, {_quoted('(?i)' + r.pattern)})), false)::INTEGER" for r in rules.SECRETS)}) AS c_secrets,
 sum(CASE WHEN regexp_matches(file_path, '(^|/)docker-compose\\.ya?ml$') AND contains(content, 'services:') THEN len(regexp_extract_all(content, 'image:')) + len(regexp_extract_all(content, 'build:')) END) AS c_services FROM {CONFIGURATION} GROUP BY collection"""
_LINES = "len(string_split(body, chr(10)))"
_QUALITY_SQL = f"""SELECT s.repo_url, s.lines, s.files, coalesce(f.n, 0) AS functions, round(greatest(0, 10 - CASE WHEN f.mean > 40 THEN 2.0 WHEN f.mean > 25 THEN 1.0 ELSE 0 END - CASE WHEN very_long > 0 THEN 1.5 WHEN long > 0 THEN 0.5 ELSE 0 END
  - CASE WHEN greatest(snake, camel) / n::DOUBLE < 0.7 THEN 1.0 ELSE 0 END - least(1.5, large * 0.3) - CASE WHEN crowded > 0 THEN 1.0 ELSE 0 END - CASE WHEN documented < 0.2 THEN 0.5 ELSE 0 END)::DOUBLE, 1) AS quality
 FROM (SELECT repo_url, count(*) FILTER (line_count > 500) AS large, coalesce(sum(line_count), 0)::BIGINT AS lines, count(*) AS files FROM {FILES} GROUP BY repo_url) s
 LEFT JOIN (SELECT repo_url, count(*) FILTER (k > 20) AS crowded FROM (SELECT repo_url, {PARENT} AS folder, count(*) AS k FROM {FILES} GROUP BY ALL) GROUP BY repo_url) d ON d.repo_url IS NOT DISTINCT FROM s.repo_url
 LEFT JOIN (SELECT repo_url, count(*) AS n, avg({_LINES}) AS mean, count(*) FILTER ({_LINES} > 50) AS long, count(*) FILTER ({_LINES} > 100) AS very_long, count(*) FILTER (regexp_matches(name, '^[a-z_][a-z0-9_]*$')) AS snake,
  count(*) FILTER (regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') AND NOT contains(name, '_')) AS camel, avg((contains(body, chr(34)||chr(34)||chr(34)) OR contains(body, ''''''''))::INTEGER) FILTER (lower(language) = 'python') AS documented FROM {FUNCTIONS} GROUP BY repo_url) f ON f.repo_url IS NOT DISTINCT FROM s.repo_url"""
_SCORES = f"""
WITH s AS ({_signs_sql()}), c AS ({_CONFIG_SQL}), q AS ({_QUALITY_SQL}), j AS (SELECT s.*, c.* EXCLUDE (collection), q.quality, q.lines, q.functions FROM s LEFT JOIN c ON c.collection = 'repo_' || substr(md5(s.repo_url), 1, 12) JOIN q ON q.repo_url IS NOT DISTINCT FROM s.repo_url),
x AS (SELECT repo_url, quality, floor((files * 0.5 + functions * 0.2 + lines * 0.005) * CASE WHEN files > 500 THEN 2.5 WHEN files > 100 THEN 1.5 ELSE 1.0 END)::BIGINT AS minutes,
 round(least(10, logging::INTEGER * 2 + CASE WHEN handling >= 3 THEN 2 WHEN handling >= 1 THEN 1 ELSE 0 END + (config OR coalesce(c_config, false))::INTEGER * 2 + coalesce(c_docker, false)::INTEGER + coalesce(c_pipeline, false)::INTEGER + CASE WHEN tests = 0 THEN 0 WHEN tests / files::DOUBLE > 0.15 THEN 2 ELSE 1 END)::DOUBLE, 1) AS production,
 round(greatest(0, 10 - 2.5 * secrets - 1.5 * coalesce(c_secrets, 0) - CASE WHEN validation THEN 0 ELSE 1 END - CASE WHEN raw_sql THEN 2 ELSE 0 END - CASE WHEN cors THEN 0 ELSE 0.5 END - CASE WHEN coalesce(c_env, false) AND NOT coalesce(c_ignored, false) THEN 1 ELSE 0 END)::DOUBLE, 1) AS security,
 round(least(10, greatest(0, 5 + async::INTEGER * 2 + (caching OR coalesce(c_caching, false))::INTEGER + (pooling OR coalesce(c_pooling, false))::INTEGER + (queues OR coalesce(c_queues, false))::INTEGER - CASE WHEN globals > 5 THEN 2 WHEN globals > 0 THEN 0.5 ELSE 0 END + coalesce(c_contained, false)::INTEGER * 0.5))::DOUBLE, 1) AS scalability FROM j)
SELECT repo_url, quality, production, security, scalability, round((quality + production + security + scalability) / 4, 1) AS overall, CASE WHEN minutes < 120 THEN '~' || minutes || ' minutes' ELSE '~' || (minutes // 60) || ' hours' END AS time_to_understand FROM x"""


@of_texts("health_scores", _SCORES)
def health_scores(spark: SparkSession, d: str, text: str) -> DataFrame:
    return scores.health(files(spark, d, text), functions(spark, d), configuration(spark, d), text)


@query("code_quality_scores", f"SELECT repo_url, quality, lines, files, functions FROM ({_QUALITY_SQL})")
def code_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.code_quality(files(spark, d), functions(spark, d))


@query("complexity_score", f"""
WITH c AS (SELECT repo_url, avg({sql_count('body', T.BRANCHES)}) AS mean, max({sql_count('body', T.BRANCHES)}) AS worst FROM {FUNCTIONS} GROUP BY repo_url), e AS (SELECT repo_url, count(*) AS edges FROM ({DEPENDENCIES}) GROUP BY repo_url),
f AS (SELECT repo_url, count(*) AS files, avg(len(string_split(file_path, '/'))) AS depth, max(len(string_split(file_path, '/'))) AS deepest FROM {FILES} GROUP BY repo_url),
j AS (SELECT repo_url, files, depth, deepest, coalesce(mean, 0) AS mean, coalesce(worst, 0) AS worst, coalesce(edges, 0) / files::DOUBLE AS density FROM f LEFT JOIN c USING (repo_url) LEFT JOIN e USING (repo_url)),
s AS (SELECT repo_url, round(least(10, least(3, mean / 5) + least(2, density / 3) + least(2, depth / 4) + least(1.5, files / 200.0) + least(1.5, worst / 20.0))::DOUBLE, 1) AS score, round(mean, 4) AS mean_complexity, worst::INTEGER AS worst, round(depth, 4) AS depth, deepest::INTEGER AS deepest, round(density, 4) AS density FROM j)
SELECT *, CASE WHEN score >= 8 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'moderate' ELSE 'low' END AS level FROM s""")
def complexity_score(spark: SparkSession, d: str) -> DataFrame:
    return scores.complexity(files(spark, d), functions(spark, d), dependencies(spark, d))


@query("complex_functions", f"""
SELECT repo_url, function_id, name, complexity, rank FROM (SELECT repo_url, function_id, name, complexity, row_number() OVER (PARTITION BY repo_url ORDER BY complexity DESC, function_id)::INTEGER AS rank FROM (SELECT *, {sql_count('body', T.BRANCHES)} AS complexity FROM {FUNCTIONS})) WHERE rank <= 10""")
def complex_functions(spark: SparkSession, d: str) -> DataFrame:
    """The ten most complex functions of each repository."""
    rows = functions(spark, d).select("repo_url", "function_id", "name", T.complexity(F.col("body"), T.BRANCHES).alias("complexity"))
    return tables.top_per_group(rows, ["repo_url"], [F.desc("complexity"), F.col("function_id")], 10)


_MODE = "SELECT repo_url, {place} AS location, '{mode}' AS mode, '{chance}' AS probability, {stage} AS stage FROM {table} WHERE {where}"


@of_texts("failure_modes", f"""
WITH k AS (SELECT repo_url, dst, count(*) AS n FROM ({CALLS}) GROUP BY ALL), u AS (
{_MODE.format(place='dst', mode='single point of failure', chance='high', stage=0, table='k', where=f'n > {scores.CALLERS}')} UNION ALL
{_MODE.format(place="file_path || '::' || name", mode='unhandled async error', chance='medium', stage=1, table=FUNCTIONS, where=f"contains(body, 'async def') AND NOT contains(body, 'try:') AND {sql_any('body', scores.OUTSIDE)}")} UNION ALL
{_MODE.format(place='file_path', mode='missing timeout', chance='medium', stage=1, table=FILES, where=f"regexp_matches(source_preview, '{scores.HTTP_CALL}') AND NOT regexp_matches(source_preview, '{scores.TIMEOUT}')")} UNION ALL
{_MODE.format(place='file_path', mode='no retry', chance='medium', stage=2, table=FILES, where=f"regexp_matches(source_preview, '{scores.CONNECTION}') AND NOT regexp_matches(source_preview, '(?i){scores.RETRY}') AND {sql_any('lower(file_path)', scores.CLIENTS)}")} UNION ALL
{_MODE.format(place='file_path', mode='endless loop', chance='low', stage=3, table=FILES, where="contains(source_preview, 'while True') AND NOT contains(source_preview, 'break')")})
SELECT repo_url, location, mode, probability FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, location ORDER BY stage) AS r FROM u) WHERE r = 1""")
def failure_modes(spark: SparkSession, d: str, text: str) -> DataFrame:
    f = functions(spark, d)
    return scores.failure_modes(files(spark, d, text), f, graph.calls(f), text)


_ARCHITECTURE = f"""
WITH f AS (SELECT repo_url, lower({PARENT}) AS dir, lower(source_preview) AS p FROM {FILES}), g AS (SELECT repo_url,
 round(0.3 * bool_or(contains(dir, 'model'))::INTEGER + 0.3 * bool_or(contains(dir, 'view') OR contains(dir, 'template'))::INTEGER + 0.3 * bool_or(contains(dir, 'controller') OR contains(dir, 'handler'))::INTEGER + 0.1 * bool_or(contains(dir, 'route'))::INTEGER, 2)::DOUBLE AS mvc,
 count(DISTINCT regexp_extract(dir, '([^/]*)$', 1)) FILTER (regexp_extract(dir, '([^/]*)$', 1) IN ({", ".join(f"'{x}'" for x in scores.LAYERS)})) AS layers,
 ({" + ".join(f"coalesce(bool_or(contains(p, '{e}')), false)::INTEGER" for e in scores.EVENTS)}) AS events, count(DISTINCT split_part(dir, '/', 1)) AS tops FROM f GROUP BY repo_url) SELECT * FROM g"""


@of_texts("architecture_signs", f"SELECT repo_url, mvc, layers, events, tops, mvc >= 0.6 AS is_mvc, layers >= 3 AS is_layered, events >= 3 AS is_event_driven FROM ({_ARCHITECTURE})")
def architecture_signs(spark: SparkSession, d: str, text: str) -> DataFrame:
    g = scores.architecture(files(spark, d, text), text).drop("gateway", "stores")
    return g.select("*", (F.col("mvc") >= 0.6).alias("is_mvc"), (F.col("layers") >= 3).alias("is_layered"), (F.col("events") >= 3).alias("is_event_driven"))


@of_texts("architecture_patterns", f"""
WITH a AS ({_ARCHITECTURE}), b AS (SELECT repo_url, bool_or(contains(lower(file_path), 'gateway')) AS gateway, bool_or(contains(lower(file_path), 'repo')) AS stores FROM {FILES} GROUP BY repo_url), c AS ({_CONFIG_SQL}),
j AS (SELECT a.repo_url, mvc, layers, events, tops, stores, CASE WHEN coalesce(c_services, 0) >= 2 THEN least(1.0, c_services / 5.0) ELSE 0.0 END + gateway::INTEGER * 0.2 AS micro FROM a JOIN b ON a.repo_url IS NOT DISTINCT FROM b.repo_url LEFT JOIN c ON c.collection = 'repo_' || substr(md5(a.repo_url), 1, 12)),
u AS (SELECT repo_url, 'MVC' AS pattern, mvc::DOUBLE AS confidence, 0 AS place FROM j WHERE mvc >= 0.6 UNION ALL SELECT repo_url, 'Layered Architecture', round(least(1, layers / 4.0), 2)::DOUBLE, 1 FROM j WHERE layers >= 3 UNION ALL
 SELECT repo_url, 'Microservices', round(least(1.0, micro), 2)::DOUBLE, 2 FROM j WHERE micro > 0.3 UNION ALL SELECT repo_url, 'Event-Driven', round(least(1, events / 6.0), 2)::DOUBLE, 3 FROM j WHERE events >= 3 UNION ALL SELECT repo_url, 'Repository Pattern', 0.7::DOUBLE, 4 FROM j WHERE stores),
m AS (SELECT * FROM u UNION ALL SELECT repo_url, 'Monolith', 0.6::DOUBLE, 5 FROM j WHERE (tops <= 3 AND micro <= 0.3) OR NOT EXISTS (SELECT 1 FROM u WHERE u.repo_url IS NOT DISTINCT FROM j.repo_url))
SELECT repo_url, pattern, confidence, row_number() OVER (PARTITION BY repo_url ORDER BY confidence DESC, place) = 1 AS is_primary FROM m""")
def architecture_patterns(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Patterns of each repository with their confidence, the surest one primary."""
    return scores.patterns(files(spark, d, text), configuration(spark, d), text)

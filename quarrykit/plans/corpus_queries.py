"""Corpus statistics, lookups, names, duplicates and order of importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import tables
from quarrykit.plans import Registry
from quarrykit.plans.data import FILES, FUNCTIONS, PREVIEW, files, functions, text_query
from quarrykit.session import table

registry = Registry()
query = registry.query
of_texts = text_query(registry)


def _list(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_any(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def sql_count(text: str, patterns: tuple[str, ...]) -> str:
    return "(1 + " + " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in patterns) + ")::INTEGER"


PARENT = "CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END"
MODULE = "CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE 'root' END"
NAME = "regexp_extract(file_path, '([^/]*)$', 1)"
STEM = f"(CASE WHEN length({NAME}) > 1 THEN regexp_replace({NAME}, '^(.+)\\.[^.]*$', '\\1') ELSE {NAME} END)"


@query("corpus_stats", f"""
SELECT (SELECT count(*) FROM {FILES}) AS files, (SELECT sum(line_count)::BIGINT FROM {FILES}) AS lines,
  (SELECT count(*) FROM {FUNCTIONS}) AS functions, (SELECT count(DISTINCT language) FROM {FILES}) AS languages, (SELECT count(DISTINCT repo_url) FROM {FILES}) AS repos""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    own = files(spark, d).agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.countDistinct("language").alias("languages"), F.countDistinct("repo_url").alias("repos"))
    return own.join(functions(spark, d).agg(F.count("*").alias("functions")), F.lit(True)).select("files", "lines", "functions", "languages", "repos")


@query("quick_stats_by_repo", f"""
SELECT repo_url, count(*) AS files, sum(line_count)::BIGINT AS lines, list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)) AS languages FROM {FILES} GROUP BY repo_url""")
def quick_stats(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("repo_url").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.array_sort(F.collect_set("language")).alias("languages"))


@query("language_counts", f"SELECT language, count(*) AS n, sum(line_count)::BIGINT AS lines FROM {FILES} GROUP BY language")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("language").agg(F.count("*").alias("n"), F.sum("line_count").alias("lines"))


@query("module_totals", f"SELECT repo_url, {MODULE} AS module, count(*) AS files, sum(line_count)::BIGINT AS lines FROM {FILES} GROUP BY ALL")
def module_totals(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("repo_url", T.module(F.col("file_path")).alias("module")).agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


@query("crowded_directories", f"SELECT repo_url, {PARENT} AS directory, count(*) AS files FROM {FILES} GROUP BY ALL HAVING count(*) > 20")
def crowded_directories(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("repo_url", T.parent(F.col("file_path")).alias("directory")).agg(F.count("*").alias("files")).where("files > 20")


@query("folder_tree", f"""
WITH p AS (SELECT DISTINCT repo_url, file_path, string_split(file_path, '/') AS parts FROM {FILES}),
x AS (SELECT repo_url, parts, unnest(range(1, len(parts) + 1)) AS depth FROM p)
SELECT repo_url, depth::INTEGER AS depth, array_to_string(parts[1:depth], '/') AS path, bool_and(depth = len(parts)) AS is_file, count(*) AS files FROM x GROUP BY ALL""")
def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    parts = files(spark, d).select("repo_url", "file_path").distinct().select("repo_url", F.split("file_path", "/").alias("parts"))
    rows = parts.select("repo_url", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    path = F.array_join(F.expr("slice(parts, 1, depth)"), "/")
    return rows.groupBy("repo_url", "depth", path.alias("path")).agg(F.bool_and(F.col("depth") == F.size("parts")).alias("is_file"), F.count("*").alias("files"))


@query("detected_languages", f"""
WITH m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in T.LANGUAGES.items())}) t(ext, lang))
SELECT coalesce(m.lang, 'unknown') AS detected, f.language AS stated, count(*) AS n FROM {FILES} f LEFT JOIN m ON m.ext = lower(regexp_extract(f.file_path, '(\\.[^./]+)$', 1)) GROUP BY ALL""")
def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(T.language(F.col("file_path")).alias("detected"), F.col("language").alias("stated")).agg(F.count("*").alias("n"))


@query("function_length_stats", f"""
SELECT repo_url, count(*) AS functions, round(avg(n), 4) AS mean_lines, count(*) FILTER (n > 50) AS long_functions, count(*) FILTER (n > 100) AS very_long
FROM (SELECT repo_url, len(string_split(body, chr(10))) AS n FROM {FUNCTIONS}) GROUP BY repo_url""")
def function_length_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = functions(spark, d).select("repo_url", T.line_count(F.col("body")).alias("n"))
    return rows.groupBy("repo_url").agg(F.count("*").alias("functions"), F.round(F.avg("n"), 4).alias("mean_lines"), F.count_if(F.col("n") > 50).alias("long_functions"), F.count_if(F.col("n") > 100).alias("very_long"))


@query("naming_style", f"""
WITH c AS (SELECT repo_url, count(*) AS n, count(*) FILTER (regexp_matches(name, '^[a-z_][a-z0-9_]*$')) AS snake,
  count(*) FILTER (regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') AND NOT contains(name, '_')) AS camel FROM {FUNCTIONS} GROUP BY repo_url)
SELECT repo_url, n, snake, camel, round(greatest(snake, camel) / n::DOUBLE, 4) AS consistency FROM c""")
def naming_style(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    rows = functions(spark, d).groupBy("repo_url").agg(F.count("*").alias("n"), F.count_if(T.is_snake(name)).alias("snake"), F.count_if(T.is_camel(name)).alias("camel"))
    return rows.withColumn("consistency", F.round(F.greatest("snake", "camel") / F.col("n"), 4))


@query("documented_ratio", f"""
SELECT repo_url, count(*) AS functions, round(avg((contains(substr(body, 1, 200), chr(34)||chr(34)||chr(34)) OR contains(substr(body, 1, 200), ''''''''))::INTEGER), 4) AS ratio
FROM {FUNCTIONS} WHERE language = 'python' GROUP BY repo_url""")
def documented_ratio(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring("body", 1, 200)
    doc = (head.contains('"""') | head.contains("'''")).cast("int")
    return functions(spark, d).where("language = 'python'").groupBy("repo_url").agg(F.count("*").alias("functions"), F.round(F.avg(doc), 4).alias("ratio"))


@query("documented_ratio_whole", f"""
SELECT repo_url, count(*) AS functions, round(avg((contains(body, chr(34)||chr(34)||chr(34)) OR contains(body, ''''''''))::INTEGER), 4) AS ratio
FROM {FUNCTIONS} WHERE lower(language) = 'python' OR regexp_matches(file_path, '(?i)\\.pyi?$') GROUP BY repo_url""")
def documented_ratio_whole(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of a docstring anywhere in a body, in all functions that are Python by their language or their path."""
    doc = (F.col("body").contains('"""') | F.col("body").contains("'''")).cast("int")
    python = (F.lower("language") == "python") | F.col("file_path").rlike(r"(?i)\.pyi?$")
    return functions(spark, d).where(python).groupBy("repo_url").agg(F.count("*").alias("functions"), F.round(F.avg(doc), 4).alias("ratio"))


@query("severity_counts", """
WITH i AS (SELECT status, branch, repo_url FROM (SELECT DISTINCT * FROM analysis_jobs))
SELECT 'status' AS dimension, status AS value, count(*) AS n FROM i GROUP BY status UNION ALL SELECT 'branch', branch, count(*) FROM i GROUP BY branch
UNION ALL SELECT 'repo_url', repo_url, count(*) FROM i GROUP BY repo_url""")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    return tables.counts(table(spark, d, "analysis_jobs").distinct(), "status", "branch", "repo_url")


@query("file_search", f"SELECT file_id, file_path FROM {FILES} WHERE contains(lower(file_path), 'token') ORDER BY file_path, file_id LIMIT 15")
def file_search(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(F.lower("file_path").contains("token")).orderBy("file_path", "file_id").limit(15).select("file_id", "file_path")


@query("function_search", f"SELECT function_id, name, file_path FROM {FUNCTIONS} WHERE contains(lower(name), 'merge') ORDER BY file_path, start_line, function_id LIMIT 15")
def function_search(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).where(F.lower("name").contains("merge")).orderBy("file_path", "start_line", "function_id").limit(15).select("function_id", "name", "file_path")


@query("point_lookup", f"""
SELECT file_id, file_path, line_count FROM {FILES} WHERE contains(file_path, 'metric') ORDER BY (file_path <> 'metric')::INTEGER, file_path, file_id LIMIT 1""")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("file_path")
    return files(spark, d).where(path.contains("metric")).orderBy((path != "metric").cast("int"), "file_path", "file_id").limit(1).select("file_id", "file_path", "line_count")


@query("module_info", f"""
SELECT {MODULE} AS module, count(*) AS files, sum(line_count)::BIGINT AS lines, list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)) AS languages FROM {FILES}
WHERE {MODULE} = 'src' GROUP BY ALL""")
def module_info(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).withColumn("module", T.module(F.col("file_path"))).where("module = 'src'")
    return rows.groupBy("module").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.array_sort(F.collect_set("language")).alias("languages"))


@query("importance_order", f"""
WITH n AS (SELECT file_id, count(*) AS k FROM {FUNCTIONS} GROUP BY file_id),
f AS (SELECT f.*, coalesce(n.k, 0) AS k, lower({STEM}) AS stem, lower(file_path) AS low FROM {FILES} f LEFT JOIN n USING (file_id))
SELECT file_id, file_path, (CASE WHEN stem IN ({_list(T.ENTRY_STEMS)}) THEN 0 WHEN stem IN ({_list(T.CONFIG_STEMS)}) THEN 1 WHEN {sql_any("low", T.ROUTE_PARTS)} THEN 2
  WHEN {sql_any("low", T.MODEL_PARTS)} THEN 3 WHEN k > 3 THEN 4 WHEN {sql_any("low", T.TEST_PARTS)} THEN 7 WHEN {sql_any("low", T.MINOR_PARTS)} THEN 9 ELSE 5 END)::INTEGER AS importance
FROM f""")
def importance_order(spark: SparkSession, d: str) -> DataFrame:
    n = functions(spark, d).groupBy("file_id").agg(F.count("*").alias("k"))
    rows = files(spark, d).join(n, "file_id", "left")
    return rows.select("file_id", "file_path", T.importance(F.col("file_path"), F.coalesce("k", F.lit(0))).alias("importance"))


@query("test_files", f"SELECT repo_url, count(*) FILTER ({sql_any('lower(file_path)', T.TEST_PARTS)}) AS tests, count(*) FILTER ({sql_any('lower(file_path)', T.MINOR_PARTS)}) AS minor, count(*) AS files FROM {FILES} GROUP BY repo_url")
def test_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("file_path")
    return files(spark, d).groupBy("repo_url").agg(F.count_if(T.is_test(path)).alias("tests"), F.count_if(T.is_minor(path)).alias("minor"), F.count("*").alias("files"))


@query("duplicate_bodies", f"""
WITH f AS (SELECT repo_url, name, function_id, len(string_split(body, chr(10))) AS n, lower(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) AS t FROM {FUNCTIONS}),
g AS (SELECT repo_url, name, function_id, n, substr(regexp_replace(t, '\\s+', ' ', 'g'), 1, 200) AS fp, length(regexp_replace(t, '\\s+', ' ', 'g')) AS len FROM f)
SELECT repo_url, fp AS fingerprint, count(*) AS copies, (list(name ORDER BY function_id))[1:4] AS names, (sum(n) - arg_min(n, function_id))::BIGINT AS duplicate_lines
FROM g WHERE len >= 80 GROUP BY repo_url, fp HAVING count(*) >= 2""")
def duplicate_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Groups of functions with the same fingerprint: names of the first four, lines but for the first."""
    return _duplicates(spark, d, T.fingerprint(F.col("body")))


@query("duplicate_bodies_whole", f"""
WITH f AS (SELECT repo_url, name, function_id, len(string_split(body, chr(10))) AS n, lower(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) AS t FROM {FUNCTIONS}),
g AS (SELECT repo_url, name, function_id, n, sha256(regexp_replace(t, '\\s+', ' ', 'g')) AS fp, length(regexp_replace(t, '\\s+', ' ', 'g')) AS len FROM f)
SELECT repo_url, fp AS fingerprint, count(*) AS copies, (list(name ORDER BY function_id))[1:4] AS names, (sum(n) - arg_min(n, function_id))::BIGINT AS duplicate_lines
FROM g WHERE len >= 80 GROUP BY repo_url, fp HAVING count(*) >= 2""")
def duplicate_bodies_whole(spark: SparkSession, d: str) -> DataFrame:
    """Groups of functions whose whole bodies are equal but for case and blanks."""
    return _duplicates(spark, d, T.whole_fingerprint(F.col("body")))


def _duplicates(spark: SparkSession, d: str, fingerprint: Column) -> DataFrame:
    rows = functions(spark, d).select("repo_url", "name", "function_id", T.line_count(F.col("body")).alias("n"), fingerprint.alias("fingerprint")).where("fingerprint is not null")
    from pyspark.sql import Window

    first = rows.withColumn("_q_r", F.row_number().over(Window.partitionBy("repo_url", "fingerprint").orderBy("function_id")))
    # only the first four of a group are gathered, so no group is collected whole
    named = first.groupBy("repo_url", "fingerprint").agg(
        F.count("*").alias("copies"), F.array_sort(F.collect_list(F.when(F.col("_q_r") <= 4, F.struct("_q_r", "name")))).alias("top"),
        (F.sum("n") - F.min_by("n", "function_id")).alias("duplicate_lines"),
    )
    return named.where("copies >= 2").select("repo_url", "fingerprint", "copies", F.transform("top", lambda t: t["name"]).alias("names"), "duplicate_lines")


@query("complexity_with_else", f"SELECT function_id, {sql_count('body', T.DECISIONS)} AS complexity FROM {FUNCTIONS}")
def complexity_with_else(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).select("function_id", T.complexity(F.col("body")).alias("complexity"))


@query("complexity_of_branches", f"SELECT function_id, {sql_count('body', T.BRANCHES)} AS complexity FROM {FUNCTIONS}")
def complexity_of_branches(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).select("function_id", T.complexity(F.col("body"), T.BRANCHES).alias("complexity"))


@query("nesting_levels", f"""
WITH l AS (SELECT function_id, unnest(string_split(body, chr(10))) AS x FROM {FUNCTIONS})
SELECT function_id, (max(CASE WHEN regexp_matches(x, '\\S') THEN length(x) - length(regexp_replace(x, '^\\s+', '')) ELSE 0 END) // 4)::INTEGER AS level FROM l GROUP BY function_id""")
def nesting_levels(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).select("function_id", T.nesting(F.col("body")).alias("level"))


@query("chunk_ids", """
SELECT DISTINCT id, substr(md5(file_path || ':' || start_line || ':' || chunk_type), 1, 16) AS chunk_id, 'repo_' || substr(md5(collection), 1, 12) AS collection_name FROM code_chunks""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_chunks")
    return rows.select("id", T.chunk_id(F.col("file_path"), F.col("start_line"), F.col("chunk_type")).alias("chunk_id"), T.collection_name(F.col("collection")).alias("collection_name")).distinct()


@query("collection_content_hash", """
WITH c AS (SELECT DISTINCT collection, id, content FROM code_chunks), h AS (SELECT collection, id, sha256(coalesce(content, '')) AS h, substr(md5(id), 1, 4) AS part FROM c),
p AS (SELECT collection, part, sha256(string_agg(id || h, '' ORDER BY id, h)) AS h, count(*) AS n FROM h GROUP BY ALL)
SELECT collection, substr(sha256(string_agg(part || h, '' ORDER BY part)), 1, 16) AS content_hash, sum(n)::BIGINT AS chunks FROM p GROUP BY collection""")
def collection_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of a collection by the hashes of its parts: 65,536 at most, so that no collection is gathered whole."""
    rows = table(spark, d, "code_chunks").select("collection", "id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")).distinct().withColumn("part", F.substring(F.md5("id"), 1, 4))
    joined = lambda a, b: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda x: F.concat(x[a], x[b])), ""), 256)
    parts = rows.groupBy("collection", "part").agg(joined("id", "h").alias("h"), F.count("*").alias("n"))
    return parts.groupBy("collection").agg(F.substring(joined("part", "h"), 1, 16).alias("content_hash"), F.sum("n").alias("chunks"))


@query("truncated_previews", f"""
SELECT file_id, CASE WHEN length(source_preview) > 300 THEN substr(source_preview, 1, 300) || chr(10) || '... [truncated]' ELSE source_preview END AS text FROM {FILES}""")
def truncated_previews(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d, PREVIEW).select("file_id", T.truncated(F.col(PREVIEW), 300).alias("text"))


@query("short_names", f"""
SELECT language, name, function_id, rank FROM (SELECT language, name, function_id, row_number() OVER (PARTITION BY language ORDER BY length(name), name, function_id)::INTEGER AS rank FROM {FUNCTIONS}) WHERE rank <= 5""")
def short_names(spark: SparkSession, d: str) -> DataFrame:
    return tables.top_per_group(functions(spark, d).select("language", "name", "function_id"), ["language"], [F.length("name"), F.col("name"), F.col("function_id")], 5)


@query("first_definition", f"SELECT name, function_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY function_id) AS r FROM {FUNCTIONS}) WHERE r = 1")
def first_definition(spark: SparkSession, d: str) -> DataFrame:
    return tables.one_per_key(functions(spark, d).select("name", "function_id", "file_path"), ["name"], ["function_id"])


@query("last_definition", f"SELECT name, function_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY function_id DESC) AS r FROM {FUNCTIONS}) WHERE r = 1")
def last_definition(spark: SparkSession, d: str) -> DataFrame:
    return tables.one_per_key(functions(spark, d).select("name", "function_id", "file_path"), ["name"], ["function_id"], last=True)


UNUSED = f"""
WITH w AS (SELECT repo_url, unnest(regexp_extract_all(source_preview, '[A-Za-z0-9_]+')) AS word FROM {FILES}), c AS (SELECT repo_url, word, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT repo_url, name, max(function_id) AS function_id FROM {FUNCTIONS} WHERE NOT starts_with(name, '_') AND length(name) > 3
  AND NOT ({" OR ".join(f"contains(lower(name), '{k}')" for k in ("test", "setup", "teardown", "main", "init"))}) GROUP BY ALL)
SELECT f.repo_url, f.name, f.function_id FROM f LEFT JOIN c ON c.repo_url = f.repo_url AND c.word = f.name WHERE coalesce(c.n, 0) <= 1"""


@of_texts("unused_functions", UNUSED)
def unused_functions(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Functions whose name stands at most once in their repository's texts: one count of all words, no scan per name."""
    words = files(spark, d, text).select("repo_url", F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("name")).groupBy("repo_url", "name").agg(F.count("*").alias("n"))
    name = F.col("name")
    own = functions(spark, d).where(~name.startswith("_") & (F.length("name") > 3) & ~T.any_of(F.lower("name"), ("test", "setup", "teardown", "main", "init")))
    return own.groupBy("repo_url", "name").agg(F.max("function_id").alias("function_id")).join(words, ["repo_url", "name"], "left").where(F.coalesce("n", F.lit(0)) <= 1).select("repo_url", "name", "function_id")


LATE = f"""
WITH l AS (SELECT file_id, generate_subscripts(string_split(source_preview, chr(10)), 1) AS pos, regexp_replace(unnest(string_split(source_preview, chr(10))), '^\\s+', '') AS x FROM {FILES} WHERE language = 'python'),
s AS (SELECT file_id, x, coalesce(bool_or(starts_with(x, 'def ') OR starts_with(x, 'async def ')) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM l)
SELECT file_id, count(*) AS n FROM s WHERE seen AND (starts_with(x, 'import ') OR starts_with(x, 'from ')) GROUP BY file_id"""


@of_texts("late_imports", LATE)
def late_imports(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Imports below the first function: a state carried over the ordered lines of a file."""
    from pyspark.sql import Window

    rows = files(spark, d, text).where("language = 'python'").select("file_id", F.posexplode(F.split(text, "\n")).alias("pos", "x")).withColumn("x", F.regexp_replace("x", r"^\s+", ""))
    line = F.col("x")
    seen = F.coalesce(F.bool_or(line.startswith("def ") | line.startswith("async def ")).over(Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("seen", seen).where(F.col("seen") & (line.startswith("import ") | line.startswith("from "))).groupBy("file_id").agg(F.count("*").alias("n"))

"""Graph queries: the trade of nations as a sparse graph, and the graphs of the code base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import graph, tables
from quarrykit.plans import Registry
from quarrykit.plans.corpus_queries import MODULE, NAME
from quarrykit.plans.data import FILES, FUNCTIONS, files, functions
from quarrykit.session import table

registry = Registry()
query = registry.query

TRADE = """(SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM (
 SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) WHERE r <= 2)"""
STEP = f"(SELECT DISTINCT src, dst FROM {TRADE} WHERE src <> dst)"


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Supplier nation to customer nation, the two strongest of each."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst")), F.col("o_custkey") == F.col("c_custkey"))
    n = rows.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return tables.top_per_group(n, ["src"], [F.desc("n"), F.col("dst")], 2).select("src", "dst")


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))


DEGREE = f"""SELECT n_nationkey AS id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree FROM nation
 LEFT JOIN (SELECT dst, count(*) AS k FROM {STEP} GROUP BY dst) i ON i.dst = n_nationkey LEFT JOIN (SELECT src, count(*) AS k FROM {STEP} GROUP BY src) o ON o.src = n_nationkey"""


@query("degrees", DEGREE)
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(nations(spark, d), graph.simple(trade(spark, d)))


@query("node_roles", f"SELECT id, CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'isolated' WHEN in_degree = 0 THEN 'entry' WHEN out_degree = 0 THEN 'leaf' ELSE 'inner' END AS role FROM ({DEGREE})")
def node_roles(spark: SparkSession, d: str) -> DataFrame:
    return graph.roles(graph.degrees(nations(spark, d), graph.simple(trade(spark, d)))).select("id", "role")


@query("hot_nodes", f"SELECT id, in_degree FROM ({DEGREE}) WHERE in_degree > 0 ORDER BY in_degree DESC, id LIMIT 10")
def hot_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.degrees(nations(spark, d), graph.simple(trade(spark, d)))
    return rows.where("in_degree > 0").orderBy(F.desc("in_degree"), "id").limit(10).select("id", "in_degree")


CLOSURE = f"WITH RECURSIVE e AS (SELECT * FROM {STEP}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"


@query("reachability", f"{CLOSURE} SELECT src, dst FROM c")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(trade(spark, d))


@query("indirect_dependents", f"{CLOSURE} SELECT dst AS id, count(*) AS n FROM (SELECT src, dst FROM c WHERE src <> dst EXCEPT SELECT src, dst FROM e) GROUP BY dst")
def indirect_dependents(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.simple(trade(spark, d))
    far = graph.closure(edges).where("src <> dst").join(edges, ["src", "dst"], "left_anti")
    return far.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


_IMPACT = f"""{CLOSURE}, a AS (SELECT dst AS id, count(*) AS n FROM c WHERE src <> dst GROUP BY dst), k AS (SELECT dst AS id, count(*) AS direct FROM e GROUP BY dst)
SELECT id, direct, n - direct AS indirect, CASE WHEN n > 5 THEN 'critical' ELSE 'important' END AS importance, CASE WHEN n > 10 THEN 'critical' WHEN n > 5 THEN 'high' WHEN n > 2 THEN 'medium' ELSE 'low' END AS risk FROM a JOIN k USING (id)"""


@query("impact_levels", _IMPACT)
def impact_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(trade(spark, d))


@query("bounded_dependents", f"""
WITH RECURSIVE e AS (SELECT * FROM {STEP}), b AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS level FROM nation WHERE n_nationkey < 5 UNION SELECT b.start, e.src, b.level + 1 FROM b JOIN e ON e.dst = b.node WHERE b.level < 3)
SELECT start, node, min(level)::INTEGER AS level FROM b GROUP BY start, node HAVING min(level) > 0""")
def bounded_dependents(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(trade(spark, d), nations(spark, d).where("id < 5").select(F.col("id").alias("start")), 3, reverse=True)


_PATHS = f"""WITH RECURSIVE e AS (SELECT * FROM {STEP}), p AS (SELECT 0 AS start, [0::INTEGER] AS path UNION ALL SELECT p.start, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.path[-1] WHERE len(p.path) <= 5 AND NOT list_contains(p.path, e.dst))"""


@query("simple_paths", f"{_PATHS} SELECT start, path FROM p WHERE len(path) > 1")
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(trade(spark, d), spark.range(1).select(F.col("id").cast("int").alias("start")), 5)


@query("shortest_paths", f"{_PATHS} SELECT path[-1] AS node, min(len(path) - 1)::INTEGER AS steps, count(*) AS paths FROM p WHERE len(path) > 1 GROUP BY node")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.paths(trade(spark, d), spark.range(1).select(F.col("id").cast("int").alias("start")), 5)
    return rows.groupBy(F.element_at("path", -1).alias("node")).agg(F.min(F.size("path") - 1).alias("steps"), F.count("*").alias("paths"))


@query("cycles", f"""
WITH RECURSIVE e AS (SELECT * FROM {STEP}), p AS (SELECT src AS start, [src] AS path FROM (SELECT DISTINCT src FROM e) UNION ALL SELECT p.start, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.path[-1] WHERE len(p.path) < 5 AND e.dst > p.start AND NOT list_contains(p.path, e.dst))
SELECT start, path FROM p JOIN e ON e.src = path[-1] AND e.dst = start""")
def cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(trade(spark, d), nations(spark, d).select(F.col("id").alias("start")), 5, close=True)


def _rank_sql(rounds: int) -> str:
    out = f"WITH e AS (SELECT * FROM {STEP}), o AS (SELECT src, count(*) AS o FROM e GROUP BY src), n AS (SELECT n_nationkey AS id, coalesce(o.o, 0) AS o, (SELECT count(*) FROM nation) AS n FROM nation LEFT JOIN o ON src = n_nationkey), r0 AS (SELECT id, o, n, 1.0::DOUBLE / n AS rank FROM n)"
    for i in range(rounds):
        out += f""", r{i + 1} AS (SELECT n.id, n.o, n.n, (0.15::DOUBLE / n.n) + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank) FILTER (o = 0), 0) FROM r{i}) / n.n) AS rank
 FROM n LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM e JOIN r{i} ON src = id GROUP BY dst) g ON g.dst = n.id)"""
    return out + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query("pagerank", _rank_sql(20))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(nations(spark, d), trade(spark, d), 20).select("id", F.round("rank", 6).alias("rank"))


@query("betweenness")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(nations(spark, d), trade(spark, d)).select("id", F.round("score", 6).alias("score"))


@query("graph_hot_spots")
def graph_hot_spots(spark: SparkSession, d: str) -> DataFrame:
    return graph.hot_spots(nations(spark, d), trade(spark, d))


@query("neighbours", f"SELECT 'out' AS side, dst AS node FROM {STEP} WHERE src = 3 UNION ALL SELECT 'in', src FROM {STEP} WHERE dst = 3")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = graph.simple(trade(spark, d))
    return e.where("src = 3").select(F.lit("out").alias("side"), F.col("dst").alias("node")).unionByName(e.where("dst = 3").select(F.lit("in").alias("side"), F.col("src").alias("node")))


# --- the code base -----------------------------------------------------------------------------------


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", "repo_url", "file_path", "language", "source").dropDuplicates(["file_id"])


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    rows = sources(spark, d)
    return graph.resolve_imports(graph.imports(rows, ["repo_url", "file_path"], "source"), rows)


_PY = "regexp_extract_all(source, '(?m)^[ \\t]*(?:from[ \\t]+([\\w.]+)[ \\t]+import|import[ \\t]+([\\w.]+))', {g})"


@query("python_imports", f"""
WITH f AS (SELECT DISTINCT file_id, file_path, language, source FROM source_files), z AS (SELECT file_id, unnest({_PY.format(g=1)}) AS a, unnest({_PY.format(g=2)}) AS b FROM f WHERE lower(language) = 'python')
SELECT file_id, CASE WHEN a <> '' THEN a ELSE b END AS import, count(*) AS n FROM z GROUP BY ALL""")
def python_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = sources(spark, d).where("lower(language) = 'python'")
    return graph.imports(rows, ["file_id"], "source").groupBy("file_id", "import").agg(F.count("*").alias("n"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def deps_sql(languages: tuple[str, ...]) -> str:
    """The dependencies of files by the imports of some languages."""
    both = " UNION ALL ".join(
        f"SELECT repo_url, file_path, generate_subscripts(regexp_extract_all(source, {_q(graph.IMPORTS[g])}, 1), 1) AS pos, unnest(regexp_extract_all(source, {_q(graph.IMPORTS[g])}, 1)) AS a, unnest(regexp_extract_all(source, {_q(graph.IMPORTS[g])}, 2)) AS b FROM s WHERE lower(language) = '{g}'"
        for g in languages
    )
    return f"""
WITH f AS (SELECT DISTINCT repo_url, file_path FROM source_files), p AS (SELECT repo_url, file_path, string_split(regexp_replace(regexp_replace(file_path, '\\.[^./]+$', ''), '/__init__$', ''), '/') AS parts FROM f),
n0 AS (SELECT repo_url, file_path, parts, unnest(range(1, len(parts) + 1)) AS i FROM p), names AS (SELECT repo_url, array_to_string(parts[i:], '.') AS name, max(file_path) AS dst FROM n0 GROUP BY ALL),
s AS (SELECT DISTINCT repo_url, file_path, language, source FROM source_files), i0 AS ({both}),
i AS (SELECT repo_url, file_path AS src, pos, list_filter(string_split(regexp_replace(CASE WHEN a <> '' THEN a ELSE b END, '[/:\\\\]+', '.', 'g'), '.'), lambda x: x <> '') AS q FROM i0),
t AS (SELECT repo_url, src, pos, q, unnest(range(1, len(q) + 1)) AS k FROM i), u AS (SELECT repo_url, src, pos, len(q) - k AS o, array_to_string(q[1:k], '.') AS name FROM t UNION ALL SELECT repo_url, src, pos, len(q) + 1, q[-1] FROM i WHERE len(q) > 0),
b AS (SELECT repo_url, src, pos, arg_min(dst, o) AS dst FROM u JOIN names USING (repo_url, name) GROUP BY ALL)
SELECT DISTINCT repo_url, src, dst FROM b WHERE src <> dst"""


DEPENDENCIES = deps_sql(tuple(graph.IMPORTS))


@query("longest_prefix_resolution", deps_sql(("python",)))
def longest_prefix_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = sources(spark, d)
    return graph.resolve_imports(graph.imports(rows.where("lower(language) = 'python'"), ["repo_url", "file_path"], "source"), rows)


@query("file_dependencies", DEPENDENCIES)
def file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return dependencies(spark, d)


CALLS = f"""
WITH f AS (SELECT * FROM {FUNCTIONS}), u AS (SELECT DISTINCT repo_url, file_path, own, src, called FROM (SELECT repo_url, file_path, name AS own, file_path || '::' || name AS src, unnest(regexp_extract_all(body, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS called FROM f) WHERE called <> own),
l AS (SELECT DISTINCT repo_url, file_path, name, file_path || '::' || name AS near FROM f), g AS (SELECT repo_url, name, arg_min(file_path || '::' || name, function_id) AS far FROM f GROUP BY ALL)
SELECT DISTINCT u.repo_url, u.src, coalesce(near, far) AS dst FROM u LEFT JOIN l ON l.repo_url = u.repo_url AND l.file_path = u.file_path AND l.name = u.called LEFT JOIN g ON g.repo_url = u.repo_url AND g.name = u.called WHERE coalesce(near, far) IS NOT NULL"""


@query("call_edges", CALLS)
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.calls(functions(spark, d))


@query("most_called", f"SELECT dst AS id, count(*) AS callers FROM ({CALLS}) GROUP BY dst ORDER BY callers DESC, id LIMIT 10")
def most_called(spark: SparkSession, d: str) -> DataFrame:
    return graph.calls(functions(spark, d)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "id").limit(10)


_FLOW = f"""
WITH f AS (SELECT * FROM {FUNCTIONS}), t AS (SELECT repo_url, file_path || '::' || name AS dst, unnest(list_filter(list_transform(parameters, lambda p: regexp_replace(split_part(split_part(p, ':', 1), '=', 1), '^\\s+|\\s+$', '', 'g')), lambda p: p <> '' AND p NOT IN ('self', 'cls', 'args', 'kwargs'))) AS name FROM f)"""


@query("parameter_names", f"{_FLOW} SELECT name, count(*) AS n FROM t GROUP BY name")
def parameter_names(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).select(F.explode(T.clean_parameters(F.col("parameters"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


_GIVEN = f"SELECT DISTINCT t.repo_url, g.src, t.dst FROM t JOIN (SELECT repo_url, name, file_path || '::' || name AS src FROM f) g ON g.repo_url = t.repo_url AND g.name = t.name WHERE g.src <> t.dst"


@query("data_flow_edges", f"{_FLOW} {_GIVEN} EXCEPT SELECT repo_url, src, dst FROM ({CALLS})")
def data_flow_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = functions(spark, d)
    return graph.data_flow(rows, graph.calls(rows))


_CLASSES = f"""SELECT repo_url, file_path, generate_subscripts(regexp_extract_all(source, {_q(graph.CLASS)}, 1), 1) AS pos, unnest(regexp_extract_all(source, {_q(graph.CLASS)}, 1)) AS name, unnest(regexp_extract_all(source, {_q(graph.CLASS)}, 2)) AS inner_
 FROM (SELECT DISTINCT file_id, repo_url, file_path, source FROM source_files WHERE lower(language) = 'python')"""
INHERITS = f"""
WITH c AS ({_CLASSES}), b AS (SELECT repo_url, file_path || '::' || name AS src, regexp_replace(unnest(string_split(inner_, ',')), '^\\s+|\\s+$', '', 'g') AS base FROM c),
n AS (SELECT repo_url, name, arg_min(file_path || '::' || name, (file_path, pos)) AS dst FROM c GROUP BY ALL)
SELECT DISTINCT b.repo_url, b.src, n.dst FROM b JOIN n ON n.repo_url = b.repo_url AND n.name = b.base WHERE b.base <> '' AND NOT contains(b.base, '=') AND b.src <> n.dst"""


@query("class_bases", INHERITS)
def class_bases(spark: SparkSession, d: str) -> DataFrame:
    """Classes and the classes they inherit from."""
    return graph.inherits(graph.classes(sources(spark, d), "source"))


_BELONGS = f"SELECT DISTINCT repo_url, file_path || '::' || name AS src, file_path AS dst FROM {FUNCTIONS}"
_CLASS_BELONGS = f"SELECT DISTINCT repo_url, file_path || '::' || name AS src, file_path AS dst FROM ({_CLASSES})"
KNOWLEDGE = f"""
{_FLOW}, e AS (SELECT *, 'belongs_to' AS type, 0 AS stage FROM ({_BELONGS}) UNION ALL SELECT *, 'belongs_to', 1 FROM ({_CLASS_BELONGS}) UNION ALL SELECT *, 'inherits', 2 FROM ({INHERITS}) UNION ALL SELECT *, 'imports', 3 FROM ({DEPENDENCIES}) UNION ALL SELECT *, 'calls', 4 FROM ({CALLS})),
w AS (SELECT *, 'data_flow' AS type, 5 AS stage FROM ({_GIVEN} EXCEPT SELECT repo_url, src, dst FROM e))
SELECT repo_url, src, dst, arg_max(type, stage) AS type FROM (SELECT * FROM e UNION ALL SELECT * FROM w) GROUP BY ALL"""


def knowledge(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the knowledge graph: membership, inheritance, imports, calls and data flow, one for each pair of ends."""
    f, c = functions(spark, d), graph.classes(sources(spark, d), "source")
    node = F.concat_ws("::", "file_path", "name")
    belongs = lambda rows: rows.select("repo_url", node.alias("src"), F.col("file_path").alias("dst")).distinct()
    stages = [("belongs_to", belongs(f)), ("belongs_to", belongs(c)), ("inherits", graph.inherits(c)), ("imports", dependencies(spark, d)), ("calls", graph.calls(f))]
    have = stages[0][1]
    for _, part in stages[1:]:
        have = have.unionByName(part)
    return graph.overwritten([*stages, ("data_flow", graph.data_flow(f, have))])


NODES = f"""SELECT repo_url, file_path AS id, 'file' AS type, {NAME} AS name FROM {FILES} UNION SELECT repo_url, file_path || '::' || name, 'function', name FROM {FUNCTIONS}
 UNION SELECT repo_url, file_path || '::' || name, 'class', name FROM ({_CLASSES}) UNION SELECT repo_url, {MODULE}, 'module', {MODULE} FROM {FILES}"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(repo_url, id, type, name): files, functions, classes and modules."""
    node = F.concat_ws("::", "file_path", "name")
    f = files(spark, d)
    parts = [f.select("repo_url", F.col("file_path").alias("id"), F.lit("file").alias("type"), T.file_name(F.col("file_path")).alias("name"))]
    parts += [x.select("repo_url", node.alias("id"), F.lit(k).alias("type"), "name") for k, x in (("function", functions(spark, d)), ("class", graph.classes(sources(spark, d), "source")))]
    parts += [f.select("repo_url", T.module(F.col("file_path")).alias("id"), F.lit("module").alias("type"), T.module(F.col("file_path")).alias("name"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


@query("knowledge_nodes", f"SELECT repo_url, type, count(*) AS n FROM ({NODES}) GROUP BY ALL")
def knowledge_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the knowledge graph by repository and type."""
    return nodes(spark, d).groupBy("repo_url", "type").agg(F.count("*").alias("n"))


@query("node_search", f"SELECT repo_url, id, name FROM ({NODES}) WHERE type = 'function' AND contains(lower(name), 'merge') ORDER BY id, repo_url LIMIT 20")
def node_search(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a type whose name contains a text, the first twenty."""
    return nodes(spark, d).where((F.col("type") == "function") & F.lower("name").contains("merge")).orderBy("id", "repo_url").limit(20).select("repo_url", "id", "name")


@query("knowledge_edges", KNOWLEDGE)
def knowledge_edges(spark: SparkSession, d: str) -> DataFrame:
    return knowledge(spark, d)


@query("knowledge_summary", f"SELECT type, count(*) AS edges, count(DISTINCT repo_url) AS repos FROM ({KNOWLEDGE}) GROUP BY type")
def knowledge_summary(spark: SparkSession, d: str) -> DataFrame:
    return knowledge(spark, d).groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("repo_url").alias("repos"))


@query("edge_overwrite", f"""
WITH c AS ({CALLS}), b AS (SELECT DISTINCT repo_url, file_path || '::' || name AS src, file_path AS dst FROM {FUNCTIONS}), u AS (SELECT *, 'belongs_to' AS type, 0 AS stage FROM b UNION ALL SELECT *, 'calls', 1 FROM c UNION ALL SELECT repo_url, dst, src, 'returns', 2 FROM c)
SELECT type, count(*) AS n FROM (SELECT repo_url, src, dst, arg_max(type, stage) AS type FROM u GROUP BY ALL) GROUP BY type""")
def edge_overwrite(spark: SparkSession, d: str) -> DataFrame:
    f = functions(spark, d)
    belongs = f.select("repo_url", F.concat_ws("::", "file_path", "name").alias("src"), F.col("file_path").alias("dst")).distinct()
    called = graph.calls(f)
    back = called.select("repo_url", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.overwritten([("belongs_to", belongs), ("calls", called), ("returns", back)]).groupBy("type").agg(F.count("*").alias("n"))


_M = lambda c: MODULE.replace("file_path", c)


@query("module_interactions", f"SELECT repo_url, {_M('src')} AS source, {_M('dst')} AS target, count(*) AS n FROM ({CALLS}) WHERE {_M('src')} <> {_M('dst')} GROUP BY ALL")
def module_interactions(spark: SparkSession, d: str) -> DataFrame:
    e = graph.calls(functions(spark, d)).select("repo_url", T.module(F.col("src")).alias("source"), T.module(F.col("dst")).alias("target"))
    return e.where("source <> target").groupBy("repo_url", "source", "target").agg(F.count("*").alias("n"))


@query("module_edge_types", f"""
SELECT repo_url, {_M('src')} AS source, {_M('dst')} AS target, count(*) AS n, list_sort(list(DISTINCT type)) AS types FROM ({KNOWLEDGE}) WHERE {_M('src')} <> {_M('dst')} GROUP BY ALL""")
def module_edge_types(spark: SparkSession, d: str) -> DataFrame:
    """Interactions of modules over all kinds of edges, with the kinds."""
    e = knowledge(spark, d).select("repo_url", T.module(F.col("src")).alias("source"), T.module(F.col("dst")).alias("target"), "type")
    return e.where("source <> target").groupBy("repo_url", "source", "target").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))


@query("known_edges", f"""
WITH n AS ({NODES}), e AS ({CALLS}) SELECT repo_url, src, dst FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.repo_url = e.repo_url AND n.id = e.src) AND EXISTS (SELECT 1 FROM n WHERE n.repo_url = e.repo_url AND n.id = e.dst)""")
def known_edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls both of whose ends are nodes of the knowledge graph."""
    return graph.between(graph.calls(functions(spark, d)), nodes(spark, d), keys=("repo_url",))


_FILE_GRAPH = f"(SELECT repo_url || '|' || src AS src, repo_url || '|' || dst AS dst FROM ({DEPENDENCIES}))"


@query("file_impact", f"""
WITH RECURSIVE e AS (SELECT * FROM {_FILE_GRAPH}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), a AS (SELECT dst AS id, count(*) AS n FROM c WHERE src <> dst GROUP BY dst), k AS (SELECT dst AS id, count(*) AS direct FROM e GROUP BY dst)
SELECT f.file_id, coalesce(k.direct, 0) AS direct, coalesce(a.n - k.direct, 0) AS indirect, CASE WHEN a.n > 10 THEN 'critical' WHEN a.n > 5 THEN 'high' WHEN a.n > 2 THEN 'medium' WHEN a.n IS NOT NULL THEN 'low' ELSE 'none' END AS risk
FROM {FILES} f LEFT JOIN a ON a.id = f.repo_url || '|' || f.file_path LEFT JOIN k ON k.id = a.id""")
def file_impact(spark: SparkSession, d: str) -> DataFrame:
    """Every file with the number of files that depend on it, at once and by way of others."""
    named = lambda c: F.concat("repo_url", F.lit("|"), F.col(c)).alias(c)
    found = graph.impact(dependencies(spark, d).select(named("src"), named("dst")))
    f = files(spark, d).select("file_id", F.concat("repo_url", F.lit("|"), "file_path").alias("id"))
    return f.join(found, "id", "left").select("file_id", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("indirect", F.lit(0)).alias("indirect"), F.coalesce("risk", F.lit("none")).alias("risk"))


# --- operators on the call graph of all repositories ---------------------------------------------------

_NODE = "coalesce(repo_url, '') || '|' || file_path || '::' || name"
CALL_GRAPH = f"(SELECT DISTINCT coalesce(repo_url, '') || '|' || src AS src, coalesce(repo_url, '') || '|' || dst AS dst FROM ({CALLS}) WHERE src <> dst)"
_ASKED = f"(SELECT DISTINCT {_NODE} AS id FROM {FUNCTIONS} WHERE function_id % 50 = 0)"


def call_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, asked): functions and calls of all repositories; asked are those whose id is divisible by 50."""
    f = functions(spark, d)
    node = F.concat(F.coalesce("repo_url", F.lit("")), F.lit("|"), F.concat_ws("::", "file_path", "name"))
    named = lambda c: F.concat(F.coalesce("repo_url", F.lit("")), F.lit("|"), c).alias(c)
    e = graph.calls(f).select(named("src"), named("dst"))
    return f.select(node.alias("id")).distinct(), graph.simple(e), f.where("function_id % 50 = 0").select(node.alias("id")).distinct()


@query("call_degrees", f"""
SELECT n.id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, CASE WHEN i.k IS NULL AND o.k IS NULL THEN 'isolated' WHEN i.k IS NULL THEN 'entry' WHEN o.k IS NULL THEN 'leaf' ELSE 'inner' END AS role
FROM (SELECT DISTINCT {_NODE} AS id FROM {FUNCTIONS}) n LEFT JOIN (SELECT dst, count(*) AS k FROM {CALL_GRAPH} GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS k FROM {CALL_GRAPH} GROUP BY src) o ON o.src = n.id""")
def call_degrees(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = call_graph(spark, d)
    return graph.roles(graph.degrees(n, e))


@query("call_reach", f"""
WITH RECURSIVE e AS (SELECT * FROM {CALL_GRAPH}), c AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM {_ASKED}) UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c""")
def call_reach(spark: SparkSession, d: str) -> DataFrame:
    """All functions that each asked function reaches by calls."""
    _, e, asked = call_graph(spark, d)
    return graph.closure(e, asked.select(F.col("id").alias("src")))


@query("call_dependents", f"""
WITH RECURSIVE e AS (SELECT * FROM {CALL_GRAPH}), b AS (SELECT id AS start, id AS node, 0 AS level FROM {_ASKED} UNION SELECT b.start, e.src, b.level + 1 FROM b JOIN e ON e.dst = b.node WHERE b.level < 3)
SELECT start, node, min(level)::INTEGER AS level FROM b GROUP BY start, node HAVING min(level) > 0""")
def call_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Functions that call each asked function, at most three steps away."""
    _, e, asked = call_graph(spark, d)
    return graph.levels(e, asked.select(F.col("id").alias("start")), 3, reverse=True)


@query("call_paths", f"""
WITH RECURSIVE e AS (SELECT * FROM {CALL_GRAPH}), p AS (SELECT id AS start, [id] AS path FROM {_ASKED} UNION ALL SELECT p.start, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.path[-1] WHERE len(p.path) <= 8 AND NOT list_contains(p.path, e.dst))
SELECT start, path FROM p WHERE len(path) > 1""")
def call_paths(spark: SparkSession, d: str) -> DataFrame:
    """Simple paths of calls of up to eight steps from each asked function."""
    _, e, asked = call_graph(spark, d)
    return graph.paths(e, asked.select(F.col("id").alias("start")), 8)


@query("call_rank")
def call_rank(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of all functions, until the ranks stand still."""
    n, e, _ = call_graph(spark, d)
    return graph.pagerank(n, e, 100, tolerance=1e-6).select("id", F.round("rank", 9).alias("rank"))


@query("call_betweenness")
def call_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness of all functions, by the shortest paths from the asked ones."""
    n, e, asked = call_graph(spark, d)
    return graph.betweenness(n, e, asked).select("id", F.round("score", 12).alias("score"))


@query("folders_of_files", f"""
WITH f AS (SELECT DISTINCT repo_url, file_path FROM {FILES}), m AS (SELECT DISTINCT repo_url, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM f WHERE contains(file_path, '/') AND length(file_path) - length(replace(file_path, '/', '')) = 1)
SELECT f.repo_url, f.file_path, m.folder FROM f JOIN m ON m.repo_url = f.repo_url AND starts_with(f.file_path, m.folder || '/')""")
def folders_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and the top folders they lie in, joined on directory prefixes instead of a comparison of all pairs."""
    f = files(spark, d).select("repo_url", "file_path").distinct()
    path = F.col("file_path")
    m = f.where(path.rlike("^[^/]*/[^/]*$")).select(F.concat_ws("|", "repo_url", T.parent(path)).alias("key"), T.parent(path).alias("folder")).distinct()
    keyed = f.withColumn("place", F.concat_ws("|", "repo_url", "file_path"))
    parts = F.split("file_path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat_ws("|", "repo_url", F.array_join(F.slice(parts, 1, n), "/")))
    return keyed.where(path.contains("/")).withColumn("key", F.explode(dirs)).join(m, "key").select("repo_url", "file_path", "folder")


@query("diagram_text", f"""
WITH e AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM {STEP} ORDER BY src::VARCHAR, dst::VARCHAR LIMIT 50)
SELECT 'graph LR' || chr(10) || string_agg('    ' || src || ' --> ' || dst, chr(10) ORDER BY src, dst) AS text FROM e""")
def diagram_text(spark: SparkSession, d: str) -> DataFrame:
    e = graph.simple(trade(spark, d)).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return graph.mermaid(e)

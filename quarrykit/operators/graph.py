"""Graphs as edge tables (src, dst): degrees, reachability, paths, cycles, ranks, impact.

Loops are driven from the client, one small action a round, and every round's table is cut by a
checkpoint in the shared folder.  Nothing of a graph is collected.  Self-edges and repeated edges
are dropped where noted; null ends never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import tables
from quarrykit.session import cut, written


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges between different ends."""
    return edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()


def between(edges: DataFrame, nodes: DataFrame, node: str = "id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges both of whose ends are nodes (within the same ``keys``)."""
    ids = nodes.select(*keys, F.col(node).alias("_q_n")).distinct()
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("_q_n", end), [*keys, end], "left_semi")
    return edges


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(id, in_degree, out_degree) of every node, zero where it has no edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.select(F.col(node).alias("id")).distinct().join(sums, "id", "left").fillna(0, ["in_degree", "out_degree"])


def roles(degree: DataFrame) -> DataFrame:
    """Entry points, leaves, isolated and inner nodes."""
    i, o = F.col("in_degree"), F.col("out_degree")
    return degree.withColumn("role", F.when((i == 0) & (o == 0), "isolated").when(i == 0, "entry").when(o == 0, "leaf").otherwise("inner"))


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst): every pair connected by a path of at least one edge; with ``seeds`` (src), from those only.

    Semi-naive: each round extends only the pairs that are new, until there are none.
    """
    step = cut(simple(edges))  # read in every round
    frontier = written(step if seeds is None else step.join(seeds.select("src").distinct(), "src", "left_semi"))
    known = frontier
    while True:
        longer = frontier.alias("f").join(step.alias("e"), F.col("f.dst") == F.col("e.src")).select("f.src", "e.dst").distinct()
        frontier = written(longer.join(known, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)  # what was written stays as it is


def levels(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(start, node, level): nodes within ``depth`` steps of each start (column ``start``), with the least number of steps."""
    step = cut(simple(edges))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    known = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("level")).distinct())
    frontier = known
    for n in range(1, depth + 1):
        nxt = frontier.join(step, F.col("node") == F.col(a)).select("start", F.col(b).alias("node")).distinct()
        frontier = cut(nxt.join(known, ["start", "node"], "left_anti").withColumn("level", F.lit(n)))
        known = known.unionByName(frontier)
    return known.where("level > 0")


def paths(edges: DataFrame, starts: DataFrame, cutoff: int, close: bool = False) -> DataFrame:
    """(start, path): all simple paths of at most ``cutoff`` edges from each start; with ``close`` the cycles.

    A cycle is listed once, from its least node.
    """
    step = cut(simple(edges))
    now = starts.select("start", F.array(F.col("start")).alias("path")).distinct()
    found = None
    for _ in range(cutoff):
        tip = F.element_at("path", -1)
        grown = now.join(step, tip == F.col("src")).select("start", "path", "dst")
        if close:
            ring = grown.where(F.col("dst") == F.col("start")).select("start", "path")
            found = ring if found is None else found.unionByName(ring)
            grown = grown.where(F.col("dst") > F.col("start"))
        now = cut(grown.where(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path")))
        if not close:
            found = now if found is None else found.unionByName(now)
    return found


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, alpha: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(id, rank): PageRank after ``rounds`` rounds; what nodes without edges hold is spread over all.

    With ``tolerance`` the rounds end when, in five of them, all ranks together change by less than
    that times the number of nodes.
    """
    step = cut(simple(edges))
    out = step.groupBy("src").agg(F.count("*").alias("o"))
    ids = cut(nodes.select("id").distinct().join(out, F.col("id") == F.col("src"), "left").select("id", F.coalesce("o", F.lit(0)).alias("o")))
    n = ids.count()
    rank = before = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        sent = step.join(rank.where("o > 0"), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("o")).alias("got"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("o") == 0, F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = ids.join(sent, F.col("id") == F.col("dst"), "left").join(F.broadcast(lost), F.lit(True))  # lost is one row
        rank = rank.select("id", "o", (F.lit((1 - alpha) / max(n, 1)) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("rank"))
        if i % 5 == 4:
            rank = cut(rank)
            if tolerance is not None:
                moved = rank.join(before.select("id", F.col("rank").alias("before")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
                if (moved or 0.0) < tolerance * n:
                    break
                before = rank
    return rank.select("id", "rank")


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): normalised betweenness of a directed graph, by Brandes' sums for all sources at once.

    Forward, the shortest paths are counted level by level; backward, each level passes its
    dependencies on.  The tables have one row per source and reachable node, so large graphs are
    given a stated set of ``sources`` (id); the sums are scaled up then, and the result is an
    unbiased estimate where the sources are chosen by hash.  Without it the result is exact.
    """
    step = cut(simple(edges))
    ids = nodes.select("id").distinct()
    n = ids.count()
    first = ids if sources is None else ids.join(sources.select("id").distinct(), "id", "left_semi")
    part_of = 1.0 if sources is None else n / max(first.count(), 1)
    known = cut(first.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    frontier, depth, stages = known, 0, [known]
    while True:
        depth += 1
        nxt = frontier.join(step, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        frontier = cut(nxt.join(known, ["s", "v"], "left_anti").select("s", "v", F.lit(depth).alias("d"), "sigma"))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier))
        stages.append(frontier)
    total, later = None, None
    for stage in reversed(stages[1:]):
        own = stage
        if later is not None:
            back = later.alias("w").join(step.alias("e"), F.col("w.v") == F.col("e.dst")).select(F.col("w.s").alias("s"), F.col("e.src").alias("v"), (F.lit(1.0) + F.col("w.delta")).alias("k"), F.col("w.sigma").alias("ws"))
            sums = stage.join(back, ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("ws") * F.col("k")).alias("delta"))
            own = stage.join(sums, ["s", "v"], "left").fillna(0.0, ["delta"])
        else:
            own = stage.withColumn("delta", F.lit(0.0))
        later = cut(own.select("s", "v", "sigma", "delta"))
        part = later.groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("score"))
        total = part if total is None else total.unionByName(part)
    if total is None:
        return ids.withColumn("score", F.lit(0.0))
    sums = total.groupBy("id").agg(F.sum("score").alias("score"))
    scale = ((n - 1) * (n - 2) if n > 2 else 1) / part_of
    return ids.join(sums, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) / scale).alias("score"))


def hot_spots(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Nodes by 1000 times PageRank, 500 times betweenness and twice the in-degree."""
    rows = pagerank(nodes, edges).join(betweenness(nodes, edges), "id").join(degrees(nodes, simple(edges)), "id")
    score = F.round(F.col("rank") * 1000 + F.col("score") * 500 + F.col("in_degree") * 2, 2)
    return rows.select("id", score.alias("hotspot"), "in_degree", "out_degree").orderBy(F.desc("hotspot"), "id").limit(n)


def impact(edges: DataFrame, function: bool = False) -> DataFrame:
    """(id, direct, indirect, importance, risk): how many nodes depend on each, at once and by way of others."""
    step = simple(edges)
    direct = step.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("direct"))
    both = closure(step).where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("all"))
    rows = both.join(direct, "id").withColumn("indirect", F.col("all") - F.col("direct"))
    n = F.col("all")
    if function:
        level = F.when(n > 8, F.struct(F.lit("critical").alias("i"), F.lit("high").alias("r"))).when(n > 3, F.struct(F.lit("important").alias("i"), F.lit("medium").alias("r"))).otherwise(F.struct(F.lit("important").alias("i"), F.lit("low").alias("r")))
    else:
        level = F.when(n > 10, F.struct(F.lit("critical").alias("i"), F.lit("critical").alias("r"))).when(n > 5, F.struct(F.lit("critical").alias("i"), F.lit("high").alias("r"))).when(n > 2, F.struct(F.lit("important").alias("i"), F.lit("medium").alias("r"))).otherwise(F.struct(F.lit("important").alias("i"), F.lit("low").alias("r")))
    return rows.withColumn("l", level).select("id", "direct", "indirect", F.col("l.i").alias("importance"), F.col("l.r").alias("risk"))


# --- graphs of a code base -------------------------------------------------------------------------

# How imports look, by language; the first group is the imported name.
IMPORTS = {
    "python": r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w.]+))", "javascript": r"""(?:import\s+[^;\n]*?from\s+['"]([^'"]+)['"]|require\s*\(['"]([^'"]+)['"]\))""",
    "typescript": r"""import\s+[^;\n]*?from\s+['"]([^'"]+)['"]()""", "java": r"import\s+([\w.]+)()", "rust": r"use\s+([\w:]+)()", "ruby": r"""require\s+['"]([^'"]+)['"]()""",
    "php": r"(?:use|require|include)\s+([^\s;]+)()", "csharp": r"using\s+([\w.]+)()", "go": r"""(?m)^\s*(?:import\s+)?"([^"]+)"()""",
}


# Fixed value: how classes with bases are declared in Python.
CLASS = r"(?m)^[ \t]*class[ \t]+(\w+)[ \t]*(?:\(([^()]*)\))?[ \t]*:"


def classes(files: DataFrame, text: str, language: str = "language") -> DataFrame:
    """(repo_url, file_path, pos, name, bases): the classes of Python files in order, with what stands in their brackets."""
    pull = lambda g: F.regexp_extract_all(text, F.lit(CLASS), F.lit(g))
    rows = files.where(F.lower(language) == "python").select("repo_url", "file_path", F.posexplode(F.arrays_zip(pull(1).alias("n"), pull(2).alias("b"))).alias("pos", "x"))
    bases = F.filter(F.transform(F.split("x.b", ","), T.trim_all), lambda b: (b != "") & ~b.contains("="))
    return rows.select("repo_url", "file_path", "pos", F.col("x.n").alias("name"), bases.alias("bases"))


def inherits(found: DataFrame) -> DataFrame:
    """(repo_url, src, dst): a class and the first class of the repository that bears the name of its base."""
    node = F.concat_ws("::", "file_path", "name")
    first = tables.one_per_key(found.select("repo_url", "name", "file_path", "pos"), ["repo_url", "name"], ["file_path", "pos"]).select("repo_url", F.col("name").alias("base"), node.alias("dst"))
    return found.select("repo_url", node.alias("src"), F.explode("bases").alias("base")).join(first, ["repo_url", "base"]).where("src <> dst").select("repo_url", "src", "dst").distinct()


def imports(files: DataFrame, keys: list[str], text: str, language: str = "language") -> DataFrame:
    """(keys..., pos, import): what files import, in order."""
    both = lambda r: F.filter(F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(r), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(r), F.lit(2)).alias("b")), lambda x: F.when(x["a"] != "", x["a"]).otherwise(x["b"])), lambda x: x != "")
    found = F.lit(None).cast("array<string>")
    for name, pattern in IMPORTS.items():
        found = F.when(F.lower(language) == name, both(pattern)).otherwise(found)
    return files.select(*keys, F.posexplode(found).alias("pos", "import"))


def resolve_imports(found: DataFrame, files: DataFrame, repo: str = "repo_url", path: str = "file_path") -> DataFrame:
    """(repo_url, src, dst): the file an import means: the longest known prefix of its name, else its last part.

    Names by which files can be imported are exploded once and joined on equality; of several
    files with one name the greatest path is meant.  Self-imports are dropped.
    """
    names = files.select(F.col(repo).alias("repo_url"), F.col(path).alias("dst"), F.explode(T.module_names(F.col(path))).alias("name")).groupBy("repo_url", "name").agg(F.max("dst").alias("dst"))
    parts = F.filter(F.split(F.regexp_replace("import", r"[/:\\]+", "."), r"\."), lambda x: x != "")
    rows = found.select(F.col(repo).alias("repo_url"), F.col(path).alias("src"), "pos", parts.alias("p")).where(F.size("p") > 0)
    tries = F.concat(
        F.transform(F.sequence(F.size("p"), F.lit(1)), lambda n: F.struct((F.size("p") - n).alias("order"), F.array_join(F.slice("p", 1, n), ".").alias("name"))),
        F.array(F.struct((F.size("p") + 1).alias("order"), F.element_at("p", -1).alias("name"))),
    )
    asked = rows.select("repo_url", "src", "pos", F.explode(tries).alias("t")).select("repo_url", "src", "pos", "t.order", "t.name")
    hit = asked.join(names, ["repo_url", "name"])
    best = hit.groupBy("repo_url", "src", "pos").agg(F.min_by("dst", "order").alias("dst"))
    return best.where("src <> dst").select("repo_url", "src", "dst").distinct()


def calls(functions: DataFrame) -> DataFrame:
    """(repo_url, src, dst): calls between functions, as ``path::name``; linear in the length of the bodies.

    Called names are taken out of the bodies and joined with definitions: those of the own file
    first, else the repository's first definition.  A function's own name is left out.
    """
    node = F.concat_ws("::", "file_path", "name")
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))
    used = functions.select("repo_url", "file_path", F.col("name").alias("own"), node.alias("src"), F.explode(names).alias("name")).where("name <> own").distinct()
    defined = functions.select("repo_url", "name", "file_path", "function_id", node.alias("dst"))
    local = defined.select("repo_url", "file_path", "name", F.col("dst").alias("near")).distinct()
    first = tables.one_per_key(defined.select("repo_url", "name", "function_id", "dst"), ["repo_url", "name"], ["function_id"]).select("repo_url", "name", F.col("dst").alias("far"))
    rows = used.join(local, ["repo_url", "file_path", "name"], "left").join(first, ["repo_url", "name"], "left")
    return rows.select("repo_url", "src", F.coalesce("near", "far").alias("dst")).where("dst is not null").distinct()


def data_flow(functions: DataFrame, existing: DataFrame) -> DataFrame:
    """(repo_url, src, dst): functions whose parameter bears another function's name, unless an edge exists."""
    node = F.concat_ws("::", "file_path", "name")
    takes = functions.select("repo_url", node.alias("dst"), F.explode(T.clean_parameters(F.col("parameters"))).alias("name"))
    gives = functions.select("repo_url", "name", node.alias("src"))
    return takes.join(gives, ["repo_url", "name"]).where("src <> dst").select("repo_url", "src", "dst").distinct().join(existing, ["repo_url", "src", "dst"], "left_anti")


def overwritten(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(repo_url, src, dst, type): one edge for each pair of ends; a later stage overwrites an earlier one."""
    rows = None
    for n, (kind, part) in enumerate(stages):
        part = part.select("repo_url", "src", "dst", F.lit(kind).alias("type"), F.lit(n).alias("stage"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("repo_url", "src", "dst").agg(F.max_by("type", "stage").alias("type"))


def prefix_modules(paths_: DataFrame, folders: DataFrame, path: str, folder: str) -> DataFrame:
    """Files with the folders they lie in: every directory prefix of a path is joined on equality."""
    parts = F.split(F.col(path), "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return paths_.withColumn("_q_d", F.explode(dirs)).join(folders, F.col("_q_d") == F.col(folder)).drop("_q_d")


def mermaid(edges: DataFrame, limit: int = 50) -> Column | DataFrame:
    """The first edges as the text of a diagram, one row."""
    clean = lambda c: F.regexp_replace(c, r"[/.\-]", "_")
    rows = edges.orderBy("src", "dst").limit(limit).select(F.struct("src", "dst", F.concat(F.lit("    "), clean("src"), F.lit(" --> "), clean("dst")).alias("line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])  # at most ``limit`` rows
    return rows.agg(F.concat(F.lit("graph LR\n"), F.array_join(lines, "\n")).alias("text"))

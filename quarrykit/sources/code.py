"""A source tree as tables: files, functions, classes, imports, chunks, configuration, folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.functions import text as T

# Folders that are not read, and names of configuration files.
SKIPPED = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", ".cache", "vendor", "target")
CONFIGURATION = (
    "requirements.txt", "setup.py", "setup.cfg", "pyproject.toml", "package.json", "tsconfig.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Gemfile",
    "composer.json", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Makefile", "CMakeLists.txt", "README.md", "README.rst", "README",
)
# How functions are declared; the first group is the name, the second the parameters.
DECLARATIONS = {
    "javascript": r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", "typescript": r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)",
    "java": r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\(([^)]*)\)", "go": r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(([^)]*)\)",
    "rust": r"(?:pub\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)", "ruby": r"def\s+(\w+)(?:\(([^)]*)\))?",
    "php": r"(?:public|private|protected)?\s*function\s+(\w+)\s*\(([^)]*)\)", "csharp": r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\(([^)]*)\)",
}
#: Declarations whose extent is told by indents, and those that ``end`` closes; braces tell that of all others.
INDENTED = {"python": (r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", r"^\s*class\s+(\w+)\s*[(:]"), "ruby": (r"^\s*def\s+(?:self\.)?(\w+)", r"^\s*class\s+(\w+)")}


def tree(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(file_path, language, size_bytes, line_count, source): the source files below a folder.

    Names, and sizes where ``max_bytes`` is set, are judged before contents are read; bytes that are no
    UTF-8 become U+FFFD.
    """
    endings = "|".join(re.escape(e[1:]) for e in T.LANGUAGES)
    root = path.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    rows = rows.withColumn("file_path", F.regexp_replace("path", rf"^(?:file:/*)?/?{re.escape(root.lstrip('/'))}/", "")).where(F.col("file_path").rlike(rf"(?i)\.(?:{endings})$"))
    rows = rows.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*[F.lit(s) for s in SKIPPED])))
    source = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("file_path", T.language(F.col("file_path")).alias("language"), F.col("length").alias("size_bytes"), T.line_count(source).alias("line_count"), source.alias("source"))


def configuration(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(name, content): known configuration files below a folder, whole or cut at ``limit`` characters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = T.file_name(F.col("path"))
    kept = rows.where(name.isin(*CONFIGURATION) | F.col("path").rlike(r"/\.github/workflows/.*\.yml$"))
    content = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.select(name.alias("name"), (content if limit is None else F.substring(content, 1, limit)).alias("content"))


def _times(line: Column, mark: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def tongue(language: Column, path: Column | None = None) -> Column:
    """The stated language in small letters; where none that is known is stated, that of the path's ending."""
    stated = F.lower(F.trim(language))
    if path is None:
        return stated
    return F.when(stated.isin(*T.LANGUAGES.values()), stated).otherwise(T.language(path))


def declarations(files: DataFrame, key: str, language: str = "language", source: str = "source", path: str | None = None) -> DataFrame:
    """(key, kind, name, start_line, end_line, parts, body, ord): functions and classes of every file.

    Texts become rows of lines, and every end of a block becomes an event of its level: the indent that a line
    returns to, or the depth of braces.  A declaration ends with the first event of its own level behind it,
    found by a window over the rows of a file, however far away that is; a block that nothing closes ends
    with the text.  ``parts`` are parameters, or the bases of a class.  Brackets in strings and comments
    count as brackets.  Null sources and languages without a pattern give no rows; of several
    declarations on one line all have that line's extent.
    """
    known = files.select(F.col(key).alias("_q_k"), tongue(F.col(language), F.col(path) if path else None).alias("_q_g"), F.col(source).alias("_q_t"))
    known = known.where(F.col("_q_t").isNotNull() & F.col("_q_g").isin(*DECLARATIONS, *INDENTED)).withColumn("_q_t", F.regexp_replace("_q_t", r"\r\n?", "\n"))
    indented = F.col("_q_g").isin(*INDENTED)
    line, file = F.col("line"), Window.partitionBy("_q_k").orderBy("n")
    rows = known.select("_q_k", "_q_g", F.posexplode(F.split("_q_t", "\n")).alias("n", "line"))
    # lines of code, for indents: no blanks, comments or lines that only close a bracket or a block
    codes = line.rlike(r"\S") & ~line.rlike(r"^\s*(?:#|[)\]}]|end\b)")
    indent = F.length(line) - F.length(F.regexp_replace(line, r"^[ \t]+", ""))
    opens, shuts = _times(line, "{"), _times(line, "}")
    # what lies within quotes over several lines is no code: an odd number of them opens before the line
    quotes = [F.coalesce(F.sum(_times(line, q) / 3).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) % 2 == 1 for q in ('"""', "'''")]
    rows = rows.withColumn("quoted", (F.col("_q_g") == "python") & (quotes[0] | quotes[1]))
    rows = rows.withColumn("indent", F.when(codes & ~F.col("quoted"), indent)).withColumn("after", F.sum(opens - shuts).over(file)).withColumn("before", F.col("after") - opens + shuts)
    filled = line.rlike(r"\S") & ~line.rlike(r"^\s*#")
    rows = rows.withColumn("outer", F.last("indent", True).over(file.rowsBetween(Window.unboundedPreceding, -1))).withColumn("filled", F.last(F.when(filled, F.col("n")), True).over(file.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.max(F.when(filled, F.col("n"))).over(Window.partitionBy("_q_k"))
    rows = rows.withColumn("last", last)
    no_event = F.array().cast("array<int>")
    # a line with ``end`` closes its own indent and belongs to the block
    final = (F.col("_q_g") == "ruby") & line.rlike(r"^\s*end\b")
    closes = F.when(final, F.array(indent)).when(
        indented, F.when(F.col("indent").isNotNull() & F.col("outer").isNotNull(), F.sequence(F.col("indent"), F.greatest("indent", "outer"))).otherwise(no_event)
    ).otherwise(F.when(F.col("after") < F.col("before"), F.sequence(F.col("after").cast("int"), F.col("before").cast("int") - 1)).otherwise(no_event))
    ends = rows.select("_q_k", F.explode(closes).alias("level"), F.when(indented & ~final, F.col("n") - 0.5).otherwise(F.col("n")).alias("at"), F.when(indented & ~final, F.col("filled")).otherwise(F.col("n")).alias("end"))
    # the part of a declaration up to its parameters stands on one line
    head = lambda p: p.removesuffix(r"([^)]*)\)")
    function = {**{g: head(p) for g, p in DECLARATIONS.items()}, **{g: p[0] for g, p in INDENTED.items()}}
    pull = lambda table: F.coalesce(*[F.when(F.col("_q_g") == g, F.regexp_extract_all(line, F.lit(p), F.lit(1))) for g, p in table.items()])
    named = lambda kind, found: F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    found = F.when(F.col("quoted"), F.lit(None)).otherwise(F.concat(named("function", pull(function)), named("class", pull({g: p[1] for g, p in INDENTED.items()}))))
    level = F.when(indented, indent).otherwise(F.col("before"))
    inline_ = ~indented & (opens > 0) & (F.col("after") <= F.col("before"))
    own = rows.withColumn("d", found).where(F.size("d") > 0).select("_q_k", level.cast("int").alias("level"), F.col("n").cast("double").alias("at"), F.col("last").alias("last"), F.when(inline_, F.col("n")).alias("end"), F.posexplode("d").alias("place", "d"))
    both = own.select("_q_k", "level", "at", "last", F.lit(None).cast("int").alias("close"), "end", "place", "d").unionByName(
        ends.select("_q_k", "level", F.col("at").cast("double").alias("at"), F.col("end").cast("int").alias("close")), allowMissingColumns=True
    )
    behind = Window.partitionBy("_q_k", "level").orderBy("at", F.col("close").isNull()).rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("stop", F.coalesce("end", F.first("close", True).over(behind), "last")).where("d is not null")
    # declarations of a file together, then with its text: the text moves once
    kept = both.groupBy("_q_k").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("n"), "place", F.greatest(F.col("stop"), F.col("at").cast("int")).alias("stop"), "d"))).alias("all"))
    texts = F.split("_q_t", "\n")
    out = known.join(kept, "_q_k").select("_q_k", "_q_g", F.posexplode(F.transform("all", lambda x: F.struct(x["n"].alias("n"), x["stop"].alias("stop"), x["d"].alias("d"), F.array_join(F.slice(texts, x["n"] + 1, x["stop"] - x["n"] + 1), "\n").alias("body")))).alias("ord", "x"))
    out = out.select("_q_k", "_q_g", "ord", "x.d.kind", "x.d.name", (F.col("x.n") + 1).alias("start_line"), (F.col("x.stop") + 1).alias("end_line"), "x.body")
    return out.select(F.col("_q_k").alias(key), "ord", "kind", "name", "start_line", "end_line", _parts(F.col("kind"), F.col("_q_g")).alias("parts"), F.when(F.col("kind") == "function", F.col("body")).otherwise("").alias("body"))


def _parts(kind: Column, language: Column) -> Column:
    """Names of the parameters at the head of ``body``, or the bases of a class: what stands in the brackets behind ``name``."""
    # brackets in brackets to two levels; possessive, so that long bodies cost no stack
    inner = r"((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)"
    text = F.expr(f"regexp_extract(body, concat('\\\\b', name, '\\\\s*(?:<[^>]*>)?\\\\s*\\\\(', r'{inner}', '\\\\)'), 1)")
    for _ in range(3):  # defaults and types may hold commas in brackets of their own
        text = F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    parts = F.filter(F.transform(F.split(text, ","), T.trim_all), lambda p: (p != "") & ~p.rlike(r"^[*/&]"))
    bare = F.transform(parts, lambda p: T.trim_all(F.regexp_replace(p, r"[:=].*$", "")))
    # other languages write the type before the name, or behind it after a blank
    typed = F.transform(parts, lambda p: F.element_at(F.split(T.trim_all(F.regexp_replace(p, r"=.*$", "")), r"\s+"), -1))
    bases = F.filter(parts, lambda p: ~p.contains("="))
    return F.when(kind == "class", bases).when(language.isin("java", "csharp", "php"), typed).when(language == "go", F.transform(parts, lambda p: F.element_at(F.split(p, r"\s+"), 1))).otherwise(bare)


def chunks(files: DataFrame, found: DataFrame, key: str, path: str = "file_path", language: str = "language", text: str = "source") -> DataFrame:
    """(chunk_id, file_path, chunk_type, content, language, start_line, end_line): texts to be indexed.

    One chunk per function with its body, one per class with its bases and the names of its methods, and one
    per file with its text, each under a head line; nothing is cut.
    """
    own = found.join(files.select(key, F.col(path).alias("file_path"), F.col(language).alias("language")), key)
    names = F.array_join(F.col("parts"), ", ")
    head = F.concat(F.lit("# File: "), "file_path", F.lit("\n"))
    fn = own.where("kind = 'function'").select("file_path", F.lit("function").alias("chunk_type"), F.concat(head, F.lit("# Function: "), "name", F.lit("("), names, F.lit(")\n"), "body").alias("content"), "language", "start_line", "end_line")
    # methods: functions within the lines of a class; both sides are met by file
    inner = found.where("kind = 'function'").select(F.col(key).alias("_q_k"), F.col("start_line").alias("_q_s"), F.col("end_line").alias("_q_e"), F.col("name").alias("_q_n"))
    classes = own.where("kind = 'class'")
    within = (F.col(key) == F.col("_q_k")) & (F.col("_q_s") > F.col("start_line")) & (F.col("_q_e") <= F.col("end_line"))
    cl = classes.join(inner, within, "left").groupBy("file_path", "language", "name", "parts", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("_q_s", "_q_n"))).alias("m"))
    methods = F.array_join(F.transform(F.filter("m", lambda x: x["_q_n"].isNotNull()), lambda x: x["_q_n"]), ", ")
    cl = cl.select("file_path", F.lit("class").alias("chunk_type"), F.concat(head, F.lit("# Class: "), "name", F.lit(" (bases: ["), names, F.lit("])\n# Methods: "), methods).alias("content"), "language", "start_line", "end_line")
    fl = files.select(F.col(path).alias("file_path"), F.lit("file").alias("chunk_type"), F.concat(F.lit("# File: "), F.col(path), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).alias("content"), F.col(language).alias("language"), F.lit(1).alias("start_line"), T.line_count(F.coalesce(F.col(text), F.lit(""))).alias("end_line"))
    rows = fn.unionByName(cl).unionByName(fl)
    return rows.select(T.chunk_id(F.col("file_path"), F.col("start_line"), F.col("chunk_type")).alias("chunk_id"), "*")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, author, ts, subject): commits from an exported log with the lines ``hash|author|ISO time|subject``."""
    parts = F.split("value", r"\|", 4)
    rows = spark.read.text(path).where(F.size(parts) == 4)
    return rows.select(parts[0].alias("hash"), parts[1].alias("author"), F.try_to_timestamp(parts[2]).alias("ts"), parts[3].alias("subject"))

"""Scores, failure modes and patterns of repositories, as aggregates over files, functions and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import rules, tables

# Words that stand for parts of a production system.
SIGNS = {
    "logging": ("logging.", "logger.", "console.log", "log.", "Log.", "slog."), "config": (".env", "dotenv", "config.", "settings.", "os.environ", "process.env"),
    "async": ("async def", "async function", "await ", "Promise", "CompletableFuture"),
}
LOW_SIGNS = {
    "validation": ("validate", "sanitize", "escape", "parameterized", "prepared"), "caching": ("cache", "redis", "memcache", "lru_cache", "@cache"),
    "pooling": ("pool", "connection_pool", "pool_size", "max_connections"), "queues": ("celery", "rabbitmq", "kafka", "queue", "pubsub", "sns", "sqs"), "cors": ("cors",),
}
# How errors are handled, and how SQL is put together from text.
HANDLING = ("try:", "except", "try {", "catch", ".catch(", "rescue", "recover")
RAW_SQL = (r"""f["'].*(?:SELECT|INSERT|UPDATE|DELETE).*\{""", r"""(?:execute|query)\s*\(\s*f["']""", r"\.format\(.*(?:SELECT|INSERT|UPDATE|DELETE)")
# Words in the names of files that build and ship.
PIPELINES = (".github/workflows", "Jenkinsfile", ".gitlab-ci")
# Signs of calls to other systems, and of what guards them.
OUTSIDE = ("await", "fetch", "query", "request")
HTTP_CALL, TIMEOUT = r"(?:requests|httpx|fetch|urllib)\.\w+\(", r"timeout\s*="
CONNECTION, RETRY = r"(?:connect|\.get|\.post|\.query)\s*\(", r"retry|backoff|tenacity|retrying"
CLIENTS = ("client", "api", "service", "connect")
#: Callers from which a function is a single point of failure.
CALLERS = 5


def some(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def signs(files: DataFrame, text: str) -> DataFrame:
    """Per repository whether any text has the signs of a production system: aggregates, no joined corpus."""
    p, path = F.col(text), F.lower("file_path")
    cols = [some(T.any_of(p, v)).alias(k) for k, v in SIGNS.items()] + [some(T.any_of(F.lower(p), v)).alias(k) for k, v in LOW_SIGNS.items()]
    handling = sum((some(p.contains(h)).cast("int") for h in HANDLING), F.lit(0))
    secret = sum((some(p.rlike("(?i)" + r.pattern)).cast("int") for r in rules.SECRETS), F.lit(0))
    raw = F.lit(False)
    for r in RAW_SQL:
        raw = raw | some(p.rlike("(?i)" + r))
    times = lambda w: F.floor((F.length(p) - F.length(F.replace(p, F.lit(w), F.lit("")))) / len(w))
    return files.groupBy("repo_url").agg(
        *cols, handling.alias("handling"), secret.alias("secrets"), raw.alias("raw_sql"), F.coalesce(F.sum(times("global ") + times("_instance = None")), F.lit(0)).alias("globals"),
        F.count_if(path.contains("test") | path.contains("spec")).alias("tests"), F.count("*").alias("files"),
    )


def configuration_signs(files: DataFrame) -> DataFrame:
    """The same of configuration files (collection, file_path, content), per collection."""
    path, low, content = F.col("file_path"), F.lower("file_path"), F.col("content")
    base = T.file_name(path)
    return files.groupBy("collection").agg(
        some(T.any_of(path, SIGNS["config"])).alias("c_config"), some(T.any_of(low, ("dockerfile", "docker-compose"))).alias("c_docker"), some(low.contains("docker")).alias("c_contained"),
        some(T.any_of(path, PIPELINES)).alias("c_pipeline"), some((base == ".gitignore") & content.contains(".env")).alias("c_ignored"), some(path.contains(".env")).alias("c_env"),
        *[some(T.any_of(F.lower(content), LOW_SIGNS[k])).alias(f"c_{k}") for k in ("caching", "pooling", "queues")],
        sum((some(content.rlike("(?i)" + r.pattern)).cast("int") for r in rules.SECRETS), F.lit(0)).alias("c_secrets"),
        F.sum(F.when(base.isin("docker-compose.yml", "docker-compose.yaml") & content.contains("services:"), F.regexp_count(content, F.lit("image:")) + F.regexp_count(content, F.lit("build:")))).alias("c_services"),
    )


def code_quality(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_url, quality, lines, functions): length of functions, names, large files, crowded folders, documentation."""
    lines, name = T.line_count(F.col("body")), F.col("name")
    doc = (F.col("body").contains('"""') | F.col("body").contains("'''")).cast("int")
    python = F.lower("language") == "python"
    f = functions.groupBy("repo_url").agg(
        F.count("*").alias("n"), F.avg(lines).alias("mean"), F.count_if(lines > 50).alias("long"), F.count_if(lines > 100).alias("very_long"),
        F.count_if(T.is_snake(name)).alias("snake"), F.count_if(T.is_camel(name)).alias("camel"), F.avg(F.when(python, doc)).alias("documented"),
    )
    crowded = files.groupBy("repo_url", T.parent(F.col("file_path")).alias("folder")).agg(F.count("*").alias("k")).groupBy("repo_url").agg(F.count_if(F.col("k") > 20).alias("crowded"))
    s = files.groupBy("repo_url").agg(F.count_if(F.col("line_count") > 500).alias("large"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"), F.count("*").alias("files"))
    same = lambda a, b: a["repo_url"].eqNullSafe(b["repo_url"])
    rows = s.join(crowded, same(s, crowded), "left").drop(crowded["repo_url"])
    rows = rows.join(f, rows["repo_url"].eqNullSafe(f["repo_url"]), "left").drop(f["repo_url"])
    lost = lambda c, x: F.when(c, x).otherwise(0.0)
    score = (
        F.lit(10.0) - F.when(F.col("mean") > 40, 2.0).when(F.col("mean") > 25, 1.0).otherwise(0.0) - F.when(F.col("very_long") > 0, 1.5).when(F.col("long") > 0, 0.5).otherwise(0.0)
        - lost(F.greatest("snake", "camel") / F.col("n") < 0.7, 1.0) - F.least(F.lit(1.5), F.col("large") * 0.3) - lost(F.col("crowded") > 0, 1.0) - lost(F.col("documented") < 0.2, 0.5)
    )
    return rows.select("repo_url", T.clamped(score).alias("quality"), "lines", "files", F.coalesce("n", F.lit(0)).alias("functions"))


def reading_time(files: Column, functions: Column, lines: Column) -> Column:
    """How long a reader needs for a code base, as text."""
    factor = F.when(files > 500, 2.5).when(files > 100, 1.5).otherwise(1.0)
    minutes = F.floor((files * 0.5 + functions * 0.2 + lines * 0.005) * factor)
    return F.when(minutes < 120, F.concat(F.lit("~"), minutes.cast("string"), F.lit(" minutes"))).otherwise(F.concat(F.lit("~"), F.floor(minutes / 60).cast("string"), F.lit(" hours")))


def health(files: DataFrame, functions: DataFrame, configuration: DataFrame, text: str) -> DataFrame:
    """(repo_url, quality, production, security, scalability, overall, time_to_understand): four scores from 0 to 10 and their mean."""
    s = signs(files, text).withColumn("collection", T.collection_name(F.col("repo_url")))
    c = configuration_signs(configuration)
    rows = s.join(c, "collection", "left").fillna(False, [x for x, t in c.dtypes if t == "boolean"]).fillna(0, ["c_secrets"])
    q = code_quality(files, functions).withColumnRenamed("repo_url", "q_repo").drop("files")
    rows = rows.join(q, F.col("repo_url").eqNullSafe(F.col("q_repo")))
    one = lambda c: F.col(c).cast("int")
    either = lambda c: (F.col(c) | F.col(f"c_{c}")).cast("int")
    ratio = F.col("tests") / F.col("files")
    production = (
        one("logging") * 2 + F.when(F.col("handling") >= 3, 2).when(F.col("handling") >= 1, 1).otherwise(0) + either("config") * 2 + one("c_docker") + one("c_pipeline")
        + F.when(F.col("tests") == 0, 0).when(ratio > 0.15, 2).otherwise(1)
    )
    exposed = F.col("c_env") & ~F.col("c_ignored")
    security = F.lit(10.0) - F.col("secrets") * 2.5 - F.col("c_secrets") * 1.5 - (1 - one("validation")) - one("raw_sql") * 2 - (1 - one("cors")) * 0.5 - exposed.cast("int")
    scale = F.lit(5.0) + one("async") * 2 + either("caching") + either("pooling") + either("queues") - F.when(F.col("globals") > 5, 2.0).when(F.col("globals") > 0, 0.5).otherwise(0.0) + one("c_contained") * 0.5
    rows = rows.select(
        "repo_url", "quality", T.clamped(production.cast("double")).alias("production"), T.clamped(security).alias("security"), T.clamped(scale).alias("scalability"),
        reading_time(F.col("files"), F.col("functions"), F.col("lines")).alias("time_to_understand"),
    )
    return rows.withColumn("overall", F.round((F.col("quality") + F.col("production") + F.col("security") + F.col("scalability")) / 4, 1))


def complexity(files: DataFrame, functions: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo_url, score, level, mean_complexity, worst, depth, deepest, density): how complex a repository is, from 0 to 10."""
    cc = T.complexity(F.col("body"), T.BRANCHES)
    c = functions.groupBy("repo_url").agg(F.avg(cc).alias("mean"), F.max(cc).alias("worst"))
    e = dependencies.groupBy("repo_url").agg(F.count("*").alias("edges"))
    depth = F.size(F.split("file_path", "/"))
    f = files.groupBy("repo_url").agg(F.count("*").alias("files"), F.avg(depth).alias("depth"), F.max(depth).alias("deepest"))
    f = f.join(c, "repo_url", "left").join(e, "repo_url", "left").fillna(0, ["mean", "worst", "edges"])
    f = f.withColumn("density", F.col("edges") / F.col("files"))
    cap = lambda x, most: F.least(F.lit(float(most)), x)
    score = cap(F.col("mean") / 5, 3) + cap(F.col("density") / 3, 2) + cap(F.col("depth") / 4, 2) + cap(F.col("files") / 200, 1.5) + cap(F.col("worst") / 20, 1.5)
    rows = f.select("repo_url", F.round(cap(score, 10), 1).alias("score"), F.round("mean", 4).alias("mean_complexity"), "worst", F.round("depth", 4).alias("depth"), "deepest", F.round("density", 4).alias("density"))
    return rows.withColumn("level", F.when(F.col("score") >= 8, "critical").when(F.col("score") >= 6, "high").when(F.col("score") >= 4, "moderate").otherwise("low"))


def failure_modes(files: DataFrame, functions: DataFrame, calls: DataFrame, text: str) -> DataFrame:
    """(repo_url, location, mode, probability): where a system may break, the first mode of each place.

    Functions that many others call, asynchronous functions that let errors through, calls to other
    systems without a timeout or a retry, and loops without an end.
    """
    node = F.concat_ws("::", "file_path", "name")
    hot = calls.groupBy("repo_url", F.col("dst").alias("location")).agg(F.count("*").alias("n")).where(F.col("n") > CALLERS)
    hot = hot.select("repo_url", "location", F.lit("single point of failure").alias("mode"), F.lit("high").alias("probability"), F.lit(0).alias("stage"))
    body, p, path = F.col("body"), F.col(text), F.lower("file_path")
    bare = functions.where(body.contains("async def") & ~body.contains("try:") & T.any_of(body, OUTSIDE))
    bare = bare.select("repo_url", node.alias("location"), F.lit("unhandled async error").alias("mode"), F.lit("medium").alias("probability"), F.lit(1).alias("stage"))
    found = F.array(
        F.when(p.rlike(HTTP_CALL) & ~p.rlike(TIMEOUT), F.struct(F.lit("missing timeout").alias("mode"), F.lit("medium").alias("probability"), F.lit(1).alias("stage"))),
        F.when(p.rlike(CONNECTION) & ~p.rlike("(?i)" + RETRY) & T.any_of(path, CLIENTS), F.struct(F.lit("no retry").alias("mode"), F.lit("medium").alias("probability"), F.lit(2).alias("stage"))),
        F.when(p.contains("while True") & ~p.contains("break"), F.struct(F.lit("endless loop").alias("mode"), F.lit("low").alias("probability"), F.lit(3).alias("stage"))),
    )
    whole = files.select("repo_url", F.col("file_path").alias("location"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("repo_url", "location", "x.*")
    return tables.union_first([hot, bare, whole], ["repo_url", "location"], ["stage"]).drop("stage")


# Folders of layers, and words of event-driven systems.
LAYERS = ("api", "routes", "service", "services", "repository", "repositories", "domain", "core", "infrastructure", "data", "presentation")
EVENTS = ("event", "listener", "handler", "subscriber", "publish", "emit", "on_event", "event_bus", "message_queue", "celery", "kafka")


def architecture(files: DataFrame, text: str) -> DataFrame:
    """(repo_url, mvc, layers, events, tops, gateway, stores): what patterns are told by."""
    f = files.select("repo_url", F.lower(T.parent(F.col("file_path"))).alias("dir"), F.lower(text).alias("p"), F.lower("file_path").alias("low"))
    in_folder = lambda *w: F.bool_or(T.any_of(F.col("dir"), w)).cast("int")
    last = T.file_name(F.col("dir"))
    events = sum((some(F.col("p").contains(e)).cast("int") for e in EVENTS), F.lit(0))
    return f.groupBy("repo_url").agg(
        F.round(in_folder("model") * 0.3 + in_folder("view", "template") * 0.3 + in_folder("controller", "handler") * 0.3 + in_folder("route") * 0.1, 2).alias("mvc"),
        F.countDistinct(F.when(last.isin(*LAYERS), last)).alias("layers"), events.alias("events"), F.countDistinct(F.split_part("dir", F.lit("/"), F.lit(1))).alias("tops"),
        some(F.col("low").contains("gateway")).alias("gateway"), some(F.col("low").contains("repo")).alias("stores"),
    )


def patterns(files: DataFrame, configuration: DataFrame, text: str) -> DataFrame:
    """(repo_url, pattern, confidence, is_primary): the architecture patterns of each repository, the surest one primary."""
    c = configuration_signs(configuration).select("collection", "c_services")
    rows = architecture(files, text).withColumn("collection", T.collection_name(F.col("repo_url"))).join(c, "collection", "left")
    services = F.coalesce("c_services", F.lit(0))
    micro = F.when(services >= 2, F.least(F.lit(1.0), services / 5)).otherwise(0.0) + F.col("gateway").cast("int") * 0.2
    of = lambda keep, name, sure, place: F.when(keep, F.struct(sure.cast("double").alias("confidence"), F.lit(-place).alias("place"), F.lit(name).alias("pattern")))
    found = F.filter(F.array(
        of(F.col("mvc") >= 0.6, "MVC", F.col("mvc"), 0), of(F.col("layers") >= 3, "Layered Architecture", F.round(F.least(F.lit(1.0), F.col("layers") / 4), 2), 1),
        of(micro > 0.3, "Microservices", F.round(F.least(F.lit(1.0), micro), 2), 2), of(F.col("events") >= 3, "Event-Driven", F.round(F.least(F.lit(1.0), F.col("events") / 6), 2), 3),
        of(F.col("stores"), "Repository Pattern", F.lit(0.7), 4)), lambda x: x.isNotNull())
    rows = rows.select("repo_url", "tops", found.alias("found"), (micro > 0.3).alias("micro"))
    single = (F.size("found") == 0) | (F.col("tops") <= 3) & ~F.col("micro")
    rows = rows.withColumn("found", F.concat("found", F.filter(F.array(of(single, "Monolith", F.lit(0.6), 5)), lambda x: x.isNotNull())))
    return rows.select("repo_url", F.array_max("found").alias("best"), F.explode("found").alias("x")).select("repo_url", "x.pattern", "x.confidence", (F.col("x.pattern") == F.col("best.pattern")).alias("is_primary"))

"""Rules over text: one scan for a whole table of rules, and the detectors built on it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import tables


class Rule(NamedTuple):
    """A pattern with what its match means; ``sql`` tells whether it is a regular pattern without look-around."""

    label: str
    pattern: str
    issue: str
    severity: str
    fix: str
    sql: bool = True


# What security scans look for.
SECURITY = (
    Rule("SQL Injection", r"""f["'].*(?:SELECT|INSERT|UPDATE|DELETE).*\{""", "String interpolation in SQL query", "critical", "Use parameterized queries"),
    Rule("SQL Injection", r"\.format\(.*(?:SELECT|INSERT|UPDATE|DELETE)", "String formatting in SQL query", "critical", "Use parameterized queries"),
    Rule("Code Injection", r"eval\s*\(", "eval() executes arbitrary code", "critical", "Use ast.literal_eval or safe parsers"),
    Rule("Code Injection", r"exec\s*\(", "exec() executes arbitrary code", "critical", "Avoid exec(), use specific functions"),
    Rule("Command Injection", r"""subprocess\.(?:call|run|Popen)\s*\(\s*(?:f["']|.*\.format|.*\+)""", "User input in subprocess command", "critical", "Use subprocess with list args, never shell=True"),
    Rule("Command Injection", r"os\.system\s*\(", "os.system() is vulnerable to shell injection", "high", "Use subprocess.run() with list args"),
    Rule("Weak Hashing", r"(?:md5|sha1)\s*\(", "MD5/SHA1 are cryptographically broken", "high", "Use SHA-256 or bcrypt for passwords"),
    Rule("Hardcoded Password", r"""password.*=.*["'][^"']{3,}["']""", "Password hardcoded in source", "critical", "Use environment variables or secrets manager"),
    Rule("Hardcoded Secret", r"""(?:api_key|apikey|secret).*=.*["'][^"']{8,}["']""", "API key or secret hardcoded", "critical", "Use environment variables"),
    Rule("SSL Verification Disabled", r"verify\s*=\s*False", "SSL certificate verification disabled", "high", "Enable SSL verification"),
    Rule("Debug Mode", r"debug\s*=\s*True", "Debug mode enabled — may expose stack traces", "medium", "Disable in production"),
    Rule("Permissive CORS", r"""CORS\s*\(\s*\w+\s*,\s*allow_origins\s*=\s*\[\s*["\*"]""", "CORS allows all origins", "medium", "Restrict to specific domains"),
    Rule("Credential Logging", r"\.(?:log|print|console\.log)\s*\(.*(?:password|token|secret|key)", "Sensitive data may be logged", "high", "Never log credentials or tokens"),
    Rule("Unsafe Deserialization", r"pickle\.load", "Pickle deserialization of untrusted data", "high", "Use JSON or validated schemas"),
    Rule("Unsafe YAML Loading", r"yaml\.load\s*\((?!.*Loader)", "yaml.load without safe Loader", "high", "Use yaml.safe_load()", False),
)
# What the secret check looks for.
SECRETS = (
    Rule("password", r"""(?:password|passwd|pwd)\s*=\s*["'][^"']{3,}["']""", "Hardcoded password detected", "critical", ""),
    Rule("api key", r"""(?:api_key|apikey|api-key)\s*=\s*["'][^"']{8,}["']""", "Hardcoded API key detected", "critical", ""),
    Rule("secret", r"""(?:secret|token)\s*=\s*["'][^"']{8,}["']""", "Hardcoded secret/token detected", "critical", ""),
    Rule("aws", r"""(?:aws_access_key|aws_secret)\s*=\s*["'][^"']{8,}["']""", "AWS credentials hardcoded", "critical", ""),
)
#: Words that make a comment look like switched-off code.
CODE_WORDS = ("def ", "function ", "class ", "import ", "return ", "if ", "for ")
#: Numbers that need no name.
PLAIN_NUMBERS = (100, 200, 201, 204, 301, 302, 400, 401, 403, 404, 500, 1000, 1024, 3000, 5000, 8000, 8080)
PENALTY = {"critical": 1.5, "high": 1.0, "medium": 0.5, "low": 0.2}


def lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys..., line, content): the lines of every text, from 1; null texts have none."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("_q_p", "content")).select(*keys, (F.col("_q_p") + 1).alias("line"), "content")


def scan(df: DataFrame, keys: Sequence[str], text: str, rules: Sequence[Rule], ignore_case: bool = True) -> DataFrame:
    """(keys..., line, label, severity, issue, fix, match): every line on which a rule matches.

    All rules are tried in one pass over the lines; of several rules with one label on a line the
    first counts.  Patterns do not reach over lines.
    """
    flag = "(?i)" if ignore_case else ""
    line = F.col("content")
    tried = [
        F.when(line.rlike(flag + r.pattern), F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.severity).alias("severity"), F.lit(r.issue).alias("issue"), F.lit(r.fix).alias("fix"), F.substring(F.regexp_extract(line, flag + r.pattern, 0), 1, 80).alias("match")))
        for i, r in enumerate(rules)
    ]
    hits = lines(df, keys, text).select(*keys, "line", F.explode(F.filter(F.array(*tried), lambda h: h.isNotNull())).alias("h")).select(*keys, "line", "h.*")
    return tables.one_per_key(hits, [*keys, "label", "line"], ["rule"]).drop("rule")


#: Limits from which structure counts as an issue, and tighter ones for code bases of short functions.
LIMITS = {"medium": 12, "high": 20, "worst": 30, "deep": 5, "name": 40, "params": 7, "module": 25, "large": 40, "broad": 3, "dead": 5}
TIGHT = {"medium": 4, "high": 5, "worst": 6, "deep": 3, "name": 20, "params": 2, "module": 5, "large": 7, "broad": 1, "dead": 1}


def quality(files: DataFrame, functions: DataFrame, limits: dict[str, int] = LIMITS, text: str = "source") -> DataFrame:
    """Issues of structure: complexity, nesting, long names, many parameters, large modules, broad handlers, dead comments, star imports."""
    f = functions.select(
        "repo_url", "file_path", F.col("start_line").alias("at"), F.col("name").alias("subject"), T.complexity(F.col("body")).alias("cc"), T.nesting(F.col("body")).alias("deep"),
        F.coalesce(F.size("parameters"), F.lit(0)).alias("params"), F.length("name").alias("len"),
    )
    cc, p, x = F.col("cc"), F.col(text), limits
    one = lambda keep, category, severity: F.when(keep, F.struct(F.lit(category).alias("category"), severity.alias("severity")))
    medium, low = F.lit("medium"), F.lit("low")
    # what is counted is counted once a row; each row gives all its issues
    spread = lambda rows, line, *found: rows.select("repo_url", "file_path", line.alias("line"), "subject", F.explode(F.filter(F.array(*found), lambda i: i.isNotNull())).alias("i")).select("repo_url", "file_path", "line", "i.category", "i.severity", "subject")
    of_functions = spread(
        f, F.col("at"),
        one(cc > x["medium"], "complexity", F.when(cc > x["worst"], "critical").when(cc > x["high"], "high").otherwise("medium")), one(F.col("deep") >= x["deep"], "nesting", medium),
        one(F.col("len") > x["name"], "naming", low), one(F.col("params") > x["params"], "parameters", medium),
    )
    n = functions.groupBy("repo_url", "file_path").agg(F.count("*").alias("n")).withColumn("subject", F.col("file_path"))
    nowhere = F.lit(None).cast("int")
    of_modules = spread(n, nowhere, one(F.col("n") > x["module"], "module size", F.when(F.col("n") > x["large"], "high").otherwise("medium")))
    trimmed = F.transform(F.split(p, "\n"), T.trim_all)
    dead = F.size(F.filter(trimmed, lambda v: (v.startswith("#") | v.startswith("//")) & T.any_of(v, CODE_WORDS)))
    broad = F.regexp_count(p, F.lit(r"\bexcept\s*:")) + F.regexp_count(p, F.lit(r"\bexcept\s+Exception\s*:"))
    s = files.select("repo_url", "file_path", F.col("file_path").alias("subject"), broad.alias("broad"), dead.alias("dead"), ((F.col("language") == "python") & p.rlike(r"from\s+\S+\s+import\s+\*")).alias("star"))
    of_files = spread(s, nowhere, one(F.col("broad") >= x["broad"], "broad handlers", medium), one(F.col("dead") >= x["dead"], "dead comments", low), one(F.col("star"), "star import", medium))
    return of_functions.unionByName(of_modules).unionByName(of_files)


#: Short names listed for each language, camel-case and unused functions, late imports and duplicate lines from which they count.
REPORT = {"short": 5, "camel": 3, "unused": 3, "much": 10, "late": 3, "lines": 50}
# Names in camel case that Python itself asks for.
ASKED_FOR = ("setUp", "tearDown", "setUpClass", "tearDownClass")


def habits(functions: DataFrame, unused: DataFrame, late: DataFrame) -> DataFrame:
    """Issues of a whole repository, in the columns of :func:`quality`: names, duplicate bodies, unused functions, late imports.

    ``unused`` (repo_url, name, function_id) and ``late`` (repo_url, file_path, n) are counted before.  No
    group is gathered: each gives its first function by id and its counts.
    """
    x, name = REPORT, F.col("name")
    out = lambda rows, line, category, severity, subject: rows.select("repo_url", "file_path", line.cast("int").alias("line"), F.lit(category).alias("category"), severity.alias("severity"), subject.cast("string").alias("subject"))
    low, medium, high, nowhere = F.lit("low"), F.lit("medium"), F.lit("high"), F.lit(None)
    f = functions.select("repo_url", "file_path", "language", "name", "start_line", "function_id")
    short = tables.top_per_group(f.where((F.length("name") <= 2) & ~name.isin("_", "__")), ["repo_url", "language"], [F.col("function_id")], x["short"])
    camel = f.where((F.col("language") == "python") & name.rlike("^[a-z][a-zA-Z]+$") & name.rlike("[A-Z]") & ~name.isin(*ASKED_FOR)).groupBy("repo_url").agg(F.count("*").alias("n"), F.min_by("file_path", "function_id").alias("file_path"))
    body = T.trim_all(F.col("body"))
    whole = functions.select("repo_url", "file_path", "name", "start_line", "function_id", T.fingerprint(F.col("body")).alias("fp"), T.line_count(body).alias("n")).where("fp is not null")
    first = F.struct("file_path", "start_line", "name")
    same = whole.groupBy("repo_url", "fp").agg(F.count("*").alias("copies"), (F.sum("n") - F.min_by("n", "function_id")).alias("lines"), F.min_by(first, "function_id").alias("f")).where("copies >= 2").select("repo_url", "lines", "f.*")
    dead = unused.join(f.select("function_id", "file_path"), "function_id").groupBy("repo_url").agg(F.count("*").alias("n"), F.min_by("file_path", "function_id").alias("file_path")).where(F.col("n") >= x["unused"])
    parts = [
        out(short, F.col("start_line"), "short name", low, name), out(camel.where(F.col("n") >= x["camel"]), nowhere, "camel case", low, F.col("n")),
        out(same, F.col("start_line"), "duplication", F.when(F.col("lines") > x["lines"], high).otherwise(medium), name),
        out(dead, nowhere, "dead code", F.when(F.col("n") > x["much"], medium).otherwise(low), F.col("n")), out(late.where(F.col("n") >= x["late"]), nowhere, "late imports", medium, F.col("n")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def penalised(issues: DataFrame, *keys: str) -> DataFrame:
    """Ten points less a penalty for every issue, within 0 and 10."""
    cost = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in PENALTY.items()], F.lit(0.2))
    return issues.groupBy(*keys).agg(F.count("*").alias("issues"), T.clamped(F.lit(10.0) - F.sum(cost)).alias("score"))


def magic_numbers(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Texts with five or more unexplained numbers of three digits and more, and the first three."""
    found = F.regexp_extract_all(text, F.lit(r"""(?<!=\s)(?<!["'])\b(\d{3,})\b(?!["'])"""), F.lit(1))
    odd = F.filter(found, lambda x: ~x.isin(*map(str, PLAIN_NUMBERS)))
    return df.select(*keys, odd.alias("n")).where(F.size("n") >= 5).select(*keys, F.size("n").alias("count"), F.slice("n", 1, 3).alias("first"))


def performance(files: DataFrame, functions: DataFrame, text: str = "source") -> DataFrame:
    """Slow patterns in functions and files, one row per place and type."""
    b, p = F.col("body"), F.col(text)
    loops = F.regexp_count(b, F.lit(r"\bfor\b")) + F.regexp_count(b, F.lit(r"\bwhile\b"))
    # what follows the head of the first loop, searched once: no pattern that tries again from each head
    inside = F.regexp_extract(b, r"for\s+\w+\s+in\s+[^\n]*:\s*\n(?s:(.*))", 1)
    query = inside.rlike(r"\.query|\.filter|\.find|\.get|\.fetch|execute")
    concat = inside.rlike(r"""\+\s*=\s*[^\n]*(?:str|["'])""")
    blocking = b.contains("async def") & b.rlike(r"\b(open|requests\.get|requests\.post|urllib|time\.sleep)\b")
    whole = p.rlike(r"\.read\(\s*\)") & ~p.rlike("(?i)chunk|stream|iter")
    getter = F.regexp_extract(p, r"def\s+get_\w+[^\n]*:\s*\n(?s:(.*))", 1)
    uncached = getter.rlike(r"\.query|requests\.|fetch|api") & ~p.rlike("(?i)cache|lru_cache|memoize|redis")
    per = lambda keep, kind, severity: F.when(keep, F.struct(F.lit(kind).alias("type"), severity.alias("severity")))
    f = functions.select("repo_url", "file_path", F.col("start_line").alias("line"), F.explode(F.filter(F.array(
        per(query, "n_plus_one", F.lit("high")), per(loops >= 3, "heavy_loop", F.when(loops > 3, "high").otherwise("medium")),
        per(blocking, "blocking_io", F.lit("high")), per(concat, "string_concat", F.lit("medium"))), lambda x: x.isNotNull())).alias("i"))
    s = files.select("repo_url", "file_path", F.lit(None).cast("int").alias("line"), F.explode(F.filter(F.array(
        per(whole, "memory_hog", F.lit("medium")), per(uncached, "no_cache", F.lit("low"))), lambda x: x.isNotNull())).alias("i"))
    return f.unionByName(s).select("repo_url", "file_path", "line", "i.type", "i.severity").dropDuplicates(["repo_url", "file_path", "type", "line"])


def endpoints(files: DataFrame, text: str = "source") -> DataFrame:
    """(repo_url, method, endpoint, framework, file_path): routes that files declare, the first of each method and path."""
    p = F.col(text)
    verb = r"(get|post|put|delete|patch)"
    call = lambda lead, group: F.regexp_extract_all(p, F.lit(rf"""(?i){lead}\.{verb}\s*\(\s*["']([^"']+)["']"""), F.lit(group))
    two = lambda name, lead: F.transform(F.arrays_zip(call(lead, 1).alias("m"), call(lead, 2).alias("e")), lambda x: F.struct(F.upper(x["m"]).alias("method"), x["e"].alias("endpoint"), F.lit(name).alias("framework")))
    spring = r"""@(Get|Post|Put|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']"""
    pull = lambda pattern, group: F.regexp_extract_all(p, F.lit(pattern), F.lit(group))
    mapped = F.transform(F.arrays_zip(pull(spring, 1).alias("m"), pull(spring, 2).alias("e")), lambda x: F.struct(F.when(x["m"] == "Request", "GET").otherwise(F.upper(x["m"])).alias("method"), x["e"].alias("endpoint"), F.lit("Spring Boot").alias("framework")))
    flask = r"""@\w+\.route\s*\(\s*["']([^"']+)["'](?:[^\n]*?methods\s*=\s*\[([^\]]+)\])?"""
    verbs = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"""["'](\w+)["']"""), F.lit(1)), F.upper)
    routed = F.flatten(F.transform(F.arrays_zip(pull(flask, 1).alias("e"), pull(flask, 2).alias("m")), lambda x: F.transform(
        F.when(F.coalesce(x["m"], F.lit("")) == "", F.array(F.lit("GET"))).otherwise(verbs(x["m"])), lambda v: F.struct(v.alias("method"), x["e"].alias("endpoint"), F.lit("Flask").alias("framework")))))
    all_ = F.concat(two("FastAPI", r"@\w+"), two("Express", r"(?:app|router)"), routed, mapped)
    rows = files.where(p.isNotNull()).select("repo_url", "file_path", F.posexplode(all_).alias("pos", "r")).select("repo_url", "file_path", "pos", "r.*")
    return tables.one_per_key(rows, ["repo_url", "method", "endpoint"], ["file_path", "pos"]).drop("pos")


def models(files: DataFrame, text: str = "source") -> DataFrame:
    """(repo_url, file_path, name, orm): data models that files declare."""
    p = F.col(text)
    kinds = {"SQLAlchemy": r"class\s+(\w+)\s*\([^\n]*?(?:Base|Model|db\.Model)[^\n]*?\):", "Django ORM": r"class\s+(\w+)\s*\([^\n]*?models\.Model[^\n]*?\):", "Prisma": r"model\s+(\w+)\s*\{[^}]+\}", "TypeORM": r"@Entity\(\)\s*class\s+(\w+)"}
    named = lambda kind: lambda n: F.struct(n.alias("name"), F.lit(kind).alias("orm"))
    parts = F.concat(*[F.transform(F.regexp_extract_all(p, F.lit(r), F.lit(1)), named(k)) for k, r in kinds.items()])
    # a schema of Mongoose bears the name of the variable it is bound to
    bound = F.transform(F.regexp_extract_all(p, F.lit(r"(\w+)\s*=\s*new\s+(?:mongoose\.)?Schema\s*\(\s*\{"), F.lit(1)), named("Mongoose"))
    return files.where(p.isNotNull()).select("repo_url", "file_path", F.explode(F.concat(parts, bound)).alias("m")).select("repo_url", "file_path", "m.*").distinct()


def relations(files: DataFrame, text: str = "source") -> DataFrame:
    """(repo_url, file_path, model, kind, target): what models of SQLAlchemy and Django refer to, known models or columns only.

    A model's body reaches from its head to the next class or the end of the text.
    """
    found = models(files, text).where(F.col("orm").isin("SQLAlchemy", "Django ORM")).select("repo_url", "file_path", "name").distinct()
    texts = files.where(F.col(text).isNotNull()).select("repo_url", "file_path", F.explode(F.split(text, r"(?m)^(?=[ \t]*class[ \t])")).alias("part"))
    parts = texts.select("repo_url", "file_path", F.regexp_extract("part", r"^[ \t]*class[ \t]+(\w+)[ \t]*\(", 1).alias("name"), "part").where("name <> ''")
    pull = lambda r, g=1: F.regexp_extract_all("part", F.lit(r), F.lit(g))
    as_kind = lambda kind, x: F.transform(x, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("target")))
    field = r"""models\.(ForeignKey|OneToOneField|ManyToManyField)\s*\(\s*["']?(\w+)"""
    django = F.transform(F.arrays_zip(pull(field, 1).alias("k"), pull(field, 2).alias("t")), lambda x: F.struct(x["k"].alias("kind"), x["t"].alias("target")))
    all_ = F.concat(as_kind("relationship", pull(r"""relationship\s*\(\s*["'](\w+)["']""")), as_kind("foreign_key", pull(r"""(?<!models\.)ForeignKey\s*\(\s*["']([^"']+)["']""")), django)
    rows = parts.join(found, ["repo_url", "file_path", "name"], "left_semi").select("repo_url", "file_path", F.col("name").alias("model"), F.explode(all_).alias("r")).select("repo_url", "file_path", "model", "r.*")
    known = found.select("repo_url", F.col("name").alias("target"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, ["repo_url", "target"], "left").where(F.col("known") | F.col("target").contains("."))
    return rows.select("repo_url", "file_path", "model", "kind", "target").distinct()

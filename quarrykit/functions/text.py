"""Column expressions on text, names and paths; none of them needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the keyword index leaves out.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "in", "on", "at", "to", "for", "of", "and", "or", "not", "it", "if", "as", "be", "by", "this", "that", "with",
    "from", "but", "has", "had", "have", "do", "does", "did", "will", "can", "may", "no", "so", "up", "def", "return", "self", "none", "true", "false", "import",
)
# Language of a file by its ending.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".java": "java", ".go": "go", ".rs": "rust",
    ".cpp": "cpp", ".c": "c", ".h": "c", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin",
}
# What counts as a decision, with and without ``else``.
DECISIONS = (r"\bif\b", r"\belif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bexcept\b", r"\bcatch\b", r"\bcase\b", r"\b\?\b", r"\band\b", r"\bor\b", r"\b&&\b", r"\b\|\|\b")
BRANCHES = (r"\bif\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\bexcept\b", r"\bcatch\b", r"\bcase\b", r"\band\b", r"\bor\b", r"\b&&\b", r"\b\|\|\b", r"\?\s*\w", r"\?\?")
# Parts of paths of tests and of files of little weight; stems and parts of weighty ones.
TEST_PARTS = ("test_", "_test.", ".test.", ".spec.", "tests/", "test/", "__tests__/", "spec/", "conftest")
MINOR_PARTS = ("fixtures/", "mock", "setup.py", "setup.cfg", "migrations/", "alembic/", ".d.ts", "types.ts")
ENTRY_STEMS = ("main", "app", "index", "server", "manage", "cli", "run", "__main__")
CONFIG_STEMS = ("config", "settings", "constants", "env")
ROUTE_PARTS = ("route", "api", "endpoint", "view", "controller", "handler")
MODEL_PARTS = ("model", "schema", "entity")
QUESTION_WORDS = ("how", "what", "why", "where", "when", "does", "explain", "describe", "tell")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text contains one of the parts."""
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Index terms: lower-case runs of letters and digits, longer than one, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, with a mark where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated]"))).otherwise(text)


def chunk_id(path: Column, line: Column, kind: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", path, line.cast("string"), kind)), 1, 16)


def collection_name(url: Column) -> Column:
    return F.concat(F.lit("repo_"), F.substring(F.md5(url), 1, 12))


def fingerprint(body: Column) -> Column:
    """The start of a body in small letters with single blanks; null for short bodies."""
    flat = F.regexp_replace(F.lower(trim_all(body)), r"\s+", " ")
    return F.when(F.length(flat) >= 80, F.substring(flat, 1, 200))


def whole_fingerprint(body: Column) -> Column:
    """The hash of a whole body in small letters with single blanks; null for short bodies."""
    flat = F.regexp_replace(F.lower(trim_all(body)), r"\s+", " ")
    return F.when(F.length(flat) >= 80, F.sha2(flat, 256))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def complexity(body: Column, patterns: tuple[str, ...] = DECISIONS) -> Column:
    """One and the number of decisions."""
    total = F.lit(1)
    for p in patterns:
        total = total + F.regexp_count(body, F.lit(p))
    return total.cast("int")


def nesting(body: Column) -> Column:
    """Deepest indent of a line that is not blank, in steps of four."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\S"))
    depth = F.array_max(F.transform(lines, lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))))
    return F.floor(F.coalesce(depth, F.lit(0)) / 4).cast("int")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The directory of a path, '.' at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def module(path: Column) -> Column:
    """The first directory of a path, 'root' where there is none."""
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("root"))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), F.lit("unknown"))


def module_names(path: Column) -> Column:
    """All dotted names by which a file can be imported: ``a.b.c``, ``b.c`` and ``c`` of ``a/b/c.py``."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"/__init__$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_test(path: Column) -> Column:
    return any_of(F.lower(path), TEST_PARTS)


def is_minor(path: Column) -> Column:
    return any_of(F.lower(path), MINOR_PARTS)


def importance(path: Column, functions: Column) -> Column:
    """Rank of a file, smallest first; names weigh more than the number of functions, that more than tests."""
    low = F.lower(path)
    name = F.lower(stem(path))
    return (
        F.when(name.isin(*ENTRY_STEMS), 0).when(name.isin(*CONFIG_STEMS), 1).when(any_of(low, ROUTE_PARTS), 2).when(any_of(low, MODEL_PARTS), 3)
        .when(functions > 3, 4).when(is_test(path), 7).when(is_minor(path), 9).otherwise(5)
    )


def is_snake(name: Column) -> Column:
    return name.rlike("^[a-z_][a-z0-9_]*$")


def is_camel(name: Column) -> Column:
    return name.rlike("^[a-z][a-zA-Z0-9]*$") & ~name.contains("_")


def clean_parameters(parameters: Column) -> Column:
    """Names of parameters without types and defaults, and without those every method has."""
    bare = F.transform(parameters, lambda p: trim_all(F.split_part(F.split_part(p, F.lit(":"), F.lit(1)), F.lit("="), F.lit(1))))
    return F.filter(bare, lambda p: (p != "") & ~p.isin("self", "cls", "args", "kwargs"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def is_keyword_query(query: Column) -> Column:
    """Whether a search text looks like identifiers rather than a question."""
    low = F.lower(query)
    asks = F.lit(False)
    for w in QUESTION_WORDS:
        asks = asks | low.startswith(w) | F.concat(F.lit(" "), low, F.lit(" ")).contains(f" {w} ")
    code = query.rlike(r"[A-Z]{2}|_[a-z]|[a-z][A-Z]|\.\w+\(|::")
    return ~asks & (code | (F.size(F.filter(F.split(query, r"\s+"), lambda x: x != "")) <= 3))


def clamped(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)), 1)


def short_name(node: Column) -> Column:
    """``name.py::f`` of ``a/b/name.py::f``."""
    return F.regexp_extract(node, r"([^/]*)$", 1)


def json_object(text: Column) -> Column:
    """A text as VARIANT: as it is, else from its first brace to its last, else null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))

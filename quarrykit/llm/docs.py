"""Functions paired with their documentation.

One recursive pattern per family of languages (the regex library) captures comments, annotations,
signature and the balanced body together; strings and comments inside the body are matched
whole, so their brackets do not count.  What the comment says decides whether the pair stays.

Defined results: null and empty bodies, and bodies without a documentation, give no pair;
repeated rows of one id count once; a null or unknown language is read off the path's ending.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRINGS = r"""(?P<str>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"""
#: Languages with comment blocks above the declaration and a body in braces.
BRACES = rf"""(?sx)
(?P<head>(?:
    (?P<com>[ \t]*/\*(?:[^*]|\*(?!/))*+\*/[ \t]*(?:\r?\n|$) | [ \t]*//[^\n]*+(?:\n|$) | [ \t]*\#(?!\[)[^\n]*+(?:\n|$))
  | (?P<ann>[ \t]*(?:@[\w.]++(?P<par>\((?:[^()"'`]++|(?&str)|(?&par))*+\))?|\#?\[(?:[^\[\]"'`]++|(?&str))*+\])[ \t]*(?:\r?\n|$|(?=\S)))
)*+)
(?P<sig>(?:[^{{}}"'`;/]++|(?&str)|/(?![/*]))*+)
(?P<body>\{{(?:[^{{}}"'`/\#]++|(?&str)|/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*+|[/\#"'`]|(?&body))*+\}})?
(?:{_STRINGS}){{0}}
"""
#: Ruby: line comments or =begin blocks above ``def``; the body ends with the text.
RUBY = r"""(?sx)
(?P<head>(?:(?P<com>[ \t]*\#[^\n]*+(?:\n|$)|=begin\b.*?\n=end[^\n]*+(?:\n|$)))*+)
(?P<sig>[ \t]*(?:(?:private|public|protected)[ \t]+)?def[ \t]+[^\n]*+)(?P<body>.*)
"""
#: Python: the docstring is the first statement below the signature.
PYTHON = rf"""(?sx)
(?:[ \t]*+(?:\#[^\n]*+)?\r?\n)*+
(?P<ann>[ \t]*@[^\n(]*+(?P<par>\((?:[^()"'\#]++|(?&str)|\#[^\n]*+|(?&par))*+\))?[^\n]*+\n(?:[ \t]*+(?:\#[^\n]*+)?\r?\n)*+)*+
(?P<sig>[ \t]*+(?:async[ \t]++)?(?:def|class)[ \t]++\w++[ \t]*+(?:\[[^\]]*+\])?(?&par)?[^\n:]*+:)
(?:[ \t]*+(?:\#[^\n]*+)?\r?\n)*+[ \t]*+
(?P<com>[rRuU]?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))?+
(?P<end>[ \t]*+(?:\r?\n|;|\#|$))?
(?P<body>.*)
(?:{_STRINGS}){{0}}
"""
#: Endings of the languages read by each pattern; all others are read as BRACES.
FAMILY = {"py": "python", "pyi": "python", "rb": "ruby", "python": "python", "ruby": "ruby"}

# Comments that tell a tool something, and words that fill a placeholder.
DIRECTIVES = (
    "eslint", "tslint", "jshint", "jslint", "prettier-ignore", "@ts-", "ts-ignore", "noqa", "nosec", "pylint", "flake8", "mypy",
    "type: ignore", "pyright", "fmt:", "yapf", "isort", "ruff", "black:", "nolint", "golint", "go:", "+build", "lint:", "checkstyle",
    "nosonar", "nopmd", "suppresswarnings", "noinspection", "resharper", "pragma", "region", "#region", "endregion", "#endregion",
    "rubocop", "frozen_string_literal", "encoding:", "coding:", "-*-", "clang-format", "clang-tidy", "clippy", "rustfmt", "phpcs",
    "phpstan", "psalm", "@codecoverageignore", "istanbul", "c8 ignore", "v8 ignore", "@formatter", "cspell", "spell-checker",
    "codespell", "editorconfig", "vim:", "stylecop", "sonar", "webpack", "@flow", "@jsx", "global ", "exported ", "coverage:",
)
PLACEHOLDERS = frozenset(
    "todo fixme xxx hack tbd tba wip na none null nil docs doc docstring documentation documented undocumented description summary "
    "comment comments explanation placeholder missing pending empty later soon blank goes here add write insert put fill your text "
    "no not yet available needed needs please stub dummy deprecated lorem ipsum untitled unknown n a".split()
)
FILLERS = frozenset(
    "a an the this that these those it its is are be was of to in on for from with by as and or at into which who what when "
    "function functions method methods procedure routine helper util utility class object subroutine operation call callback "
    "simply just basically given used use uses using order do does doing done perform performs performing return returns returned "
    "returning result results value values some any new current main actual implementation implements handle handles handling "
    "will can should may gets get sets set def func fn public private static async void self input output".split()
)
_MARK = regex.compile(r"(?i)(?:^|(?<=[.!?;:)\n]))[\s*]*(?:@?todo|fixme|xxx|hack|tbd|wip)\b(?!\s+(?:list|item|app)s?\b).*?(?=\n\s*\n|$)", regex.S)
_TAG = regex.compile(r"\s*(?:#+\s*)?(?:@\w+|:\w+[^:\n]*:|\\(?:param|returns?|brief)\b|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Examples?|Notes?|See also|Attributes|Deprecated)\s*:?\s*$)", regex.I)
_ENTRY = regex.compile(r"\s*[*`]*[\w$.]+[*`]*\s*(?:\([^)]*\))?\s*:(?:\s|$)")
_SECTION = regex.compile(r"\s*(?:#+\s*)?(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Attributes)\s*:?\s*$", regex.I)
_CODE = regex.compile(
    r"""\s*(?:[\w.$\[\]>'"-]+\s*(?:[-+*/%|&^]|:|\?\?|<<|>>)?=[^=>].*[;)\]}\w'"]\s*;?|(?:return|throw|raise|break|continue|yield|await|delete|import|use|using|package|print|puts|echo)\b[^.]*[;()\[\]{}=][^.]*
      |(?:if|for|foreach|while|switch|catch|elif|else\s+if|match|with|unless)\b.*[({:].*[{:)]\s*|(?:const|let|var|val|int|long|String|def|fn|func|function|public|private|static|class)\b.*[={;(].*
      |\$?[\w.$>:-]+\([^)]*\)\s*;?|[{}()\[\];,]+)\s*""",
    regex.X,
)


@lru_cache(maxsize=4)
def _pattern(family: str):
    return regex.compile({"python": PYTHON, "ruby": RUBY}.get(family, BRACES))


def _words(text: str) -> list[str]:
    """Lower-case words, names split at case changes and underscores."""
    text = regex.sub(r"(?<=\p{Ll}|\d)(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ", text)
    return [w.lower() for w in regex.findall(r"\p{L}+|\d+", text)]


def _same(word: str, part: str) -> bool:
    """Whether a word is an inflected form of a part of the name, as ``applies`` of ``apply``."""
    stem = part[: max(3, len(part) - 1)] if len(part) > 3 else part
    return word == part or (word.startswith(stem) and len(word) - len(part) <= 4)


def description(comment: str, family: str) -> str:
    """The running text of a comment: without marks, tags, separators, directives and dead code."""
    if family == "python":
        body = regex.sub(r"""^[rRuU]?(\"\"\"|'''|"|')|(\"\"\"|'''|"|')$""", "", comment.strip())
    else:
        body = regex.sub(r"/\*+!?|\*+/|(?m:^[ \t]*(?:///?!?|\*+|#+)(?![\w/])[ \t]?)|(?m:^[ \t]*(?:///?!?|#)[ \t]?)|(?m:^=(?:begin|end)\b.*$)", "", comment)
    body = regex.sub(r"<(?:param|returns|typeparam|exception|value)\b[^>]*>.*?</(?:param|returns|typeparam|exception|value)>", "", body.replace("\r", ""), flags=regex.S)
    body = regex.sub(r"</?[a-zA-Z][^<>\n]*>|&\w+;", " ", body)
    lines, listing = [], False
    for line in body.split("\n"):
        bare = line.strip()
        if not bare:
            lines.append("")
            listing = False
            continue
        if regex.fullmatch(r"[-=~_*#+.\s/|<>]*", bare):
            continue  # the underline of a section does not end it
        if regex.search(r"([-=~*#_/+])\1{3,}", bare) or bare.lower().lstrip("@#!- ").startswith(tuple(d.lstrip("@#!- ") for d in DIRECTIVES)) and not _prose(bare):
            continue
        if _TAG.match(bare):
            listing = bool(_SECTION.match(bare)) or not regex.match(r"(?i)deprecated|note|example", bare)
            continue
        if listing or _CODE.fullmatch(bare):
            continue
        lines.append(line)
    return _MARK.sub(" ", "\n".join(lines)).strip()


def _prose(line: str) -> bool:
    """Whether a line that begins like a directive is a sentence all the same."""
    return len(regex.findall(r"(?<![\w-])\p{L}{2,}(?![\w-])", line)) >= 6 and line.rstrip().endswith((".", "!", "?"))


def tells(text: str, name: str) -> bool:
    """Whether a description says more than the name and no placeholder."""
    parts = [w for w in _words(name) if w not in ("a", "the")]
    left = [w for w in _words(text) if w not in FILLERS and not any(_same(w, p) for p in parts)]
    rest = [w for w in left if w not in PLACEHOLDERS and not w.isdigit() and len(w) > 1]
    return bool(rest)


def pair(body: str | None, name: str | None, family: str) -> tuple[str | None, str | None, str | None, bool]:
    """(description, signature, code, tells) of one function's text."""
    if not body:
        return None, None, None, False
    m = _pattern(family).match(body)
    if m is None and family != "braces":
        family, m = "braces", _pattern("braces").match(body)
    if m is None or not m.group("sig").strip():
        return None, None, None, False
    comments = m.captures("com")
    if family == "python":
        comments = comments[:1] if comments and m.group("end") is not None else []
    text = description("\n".join(c.strip("\r\n") for c in comments), family)
    return text or None, m.group("sig").strip(), (m.group("sig") + (m.group("body") or "")).strip(), bool(text) and tells(text, name or "")


def pairs(df: DataFrame, id: str = "function_id", body: str = "body", name: str = "name", language: str = "language", path: str = "file_path") -> DataFrame:
    """(id, name, language, description, signature, code, tells): one row per documented function."""
    ending = F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    tongue = F.lower(F.coalesce(F.col(language), F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    family = F.coalesce(F.try_element_at(known, ending), F.when(ending == "", F.try_element_at(known, tongue)), F.lit("braces"))

    @F.pandas_udf("description string, signature string, code string, tells boolean")
    def read(bodies: pd.Series, names: pd.Series, families: pd.Series) -> pd.DataFrame:
        rows = [pair(b, n, f) for b, n, f in zip(bodies, names, families)]
        return pd.DataFrame(rows, columns=["description", "signature", "code", "tells"])

    rows = df.select(F.col(id).alias("_q_id"), F.col(name).alias("name"), F.col(language).alias("language"), read(body, name, family).alias("_q_p"))
    return rows.where(F.col("_q_p.description").isNotNull()).select(F.col("_q_id").alias(id), "name", "language", "_q_p.*")

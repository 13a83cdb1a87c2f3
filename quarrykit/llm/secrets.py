"""Credentials in code, comments and configuration: finding and masking.

Token formats, key armor, connection strings, logins and names of secrets are one deterministic
automaton over bytes.  It scans all texts of a batch as overlapping chunks side by side.  Where it ends a
token, an armor or a connection string, the same grammar read backwards from there gives the start, and
both the span of the value; where it ends the name of a secret, the literal bound to that name is taken.
What is a placeholder or a reference is dropped.  Spans that overlap, as those of several grammars or of
neighbouring chunks, are merged, then placeholders are spliced in.

Defined results: null and empty texts have no spans and come out as they are; repeated rows of a
key are found once; a value over several lines counts on its first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.automaton import Automaton

MASK = "[REDACTED]"

class Rule(NamedTuple):
    """A grammar of the automaton: what its match is, and where in the match the value begins."""

    kind: str
    pattern: str


_B = "[^A-Za-z0-9]"  # no token begins in the middle of a word
# Public formats of tokens; tokens of services with their own prefix, as ab-pat-... or abtk_...; key armor;
# connection strings; logins on a command line; names of secrets with what joins them to a value, and words before one.
RULES = (
    *[
        Rule("token", _B + p)
        for p in (
            r"gh[pousr]_[A-Za-z0-9]{30,}", r"github_pat_[A-Za-z0-9_]{30,}", r"AIza[0-9A-Za-z_-]{35}", r"xox[abeoprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}", r"sk-(?:[a-z]+-)?[A-Za-z0-9]{32,}", r"[a-z]{2,4}_(?:live|test)_[A-Za-z0-9]{20,}",
            r"glpat-[A-Za-z0-9_-]{20,}", r"npm_[A-Za-z0-9]{36}", r"hf_[A-Za-z0-9]{30,}", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        )
    ],
    Rule("word", _B + r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    Rule("prefixed", r"[^A-Za-z0-9_/+=-][a-z]{2,6}(?:[-_](?:pat|tok|token|sec|secret|key|live|test|prod|sk))?[-_][A-Za-z0-9]{24,}"),
    Rule("key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"), Rule("key end", r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"),
    Rule("public", r"-----BEGIN (?:CERTIFICATE|(?:[A-Z0-9]+ )*PUBLIC KEY|CERTIFICATE REQUEST|X509 CRL)[^\n-]*-----"), Rule("public end", r"-----END [^\n-]*-----"),
    Rule("connection", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>`]*:[^\s\"'<>`]+@[\w\[]"),
    Rule("login", r"\s-u\s+[\"']?[\w.-]+:[^\s\"'`]+"),
    Rule("element", r"(?i)<[a-z0-9_.:-]*(?:passw(?:or)?d|pwd|passphrase|secret|token|api[_-]?key|credential)[a-z0-9_.-]*>[^<>\s]{6,}</"),
    Rule("name", r"(?i)(?:passw|pwd|passphrase|pass|secret|token|credential|api[_ -]?key|auth|key)[a-z0-9_.-]*[\"'\])]*(?:[ \t]+string)?[ \t]*[:=,(]"),
    Rule("name", r"(?i)(?:password|passwd|passphrase|secret|token|key|login|credential)s? "),
)
_DULL = re.compile(r"(?i)x{6}|\*{3}|0{8}|1234567|abcdefg")
_NAME = re.compile(
    r"""(?i)(?P<name>(?:[\w$.-]*?(?<![a-z]))?(?:passw(?:or)?d|passwd|passphrase|pwd|pass|secrets?|tokens?|credentials?|auth|api[_ -]?key|access[_-]?key|(?:(?<=[a-z])|[_.-]|\b)key)(?![a-z])[\w.-]*|[\w$.-]*?[a-z](?-i:Pass|Pwd|Password|Passwd|Secret|Token|Key|Auth)(?![a-z])[\w.-]*|authorization)
        ["'`\])]*(?:[ \t]+string\b)?\s*(?P<join>:=|=>|==?|\?\?|\?:|\|\||\bor\b|:|,|\()\s*""",
    re.X,
)
#: Names that are near a secret but hold none, by their last part; and all that is public or a count.
_HARMLESS = re.compile(
    r"(?i)(?:field|name|names|url|uri|endpoint|path|file|dir|count|size|length|len|type|kind|id|ids|policy|hash|digest|hint|label|prompt|regex|pattern|min|max|ttl|expiry|expires|expiration|limit|enabled|required|env|var|header|prefix|suffix|param|column|version|helper|pool|host|port|user|username|store|manager|service|provider|budget|window|index)\d*$"
    r"|public[_-]?key|verify[_-]?key|max[_-]?token|host[_-]?key|cache[_-]?key|sort[_-]?key|primary[_-]?key|foreign[_-]?key|partition[_-]?key"
)
_STRONG = re.compile(r"(?i)passw|pwd|passphrase|pass(?![a-z])|secret|credential|api[_-]?key|access[_-]?key|private|signing|auth|(?:api|access|auth|refresh|bearer|session|private|bot|deploy|service)[_-]?(?:token|key)")
#: Names whose quoted literal may be small letters only, and words that no such password is made of.
_PASSWORD = re.compile(r"(?i)passw|pwd|passphrase")
_ORDINARY = re.compile(r"pass|pwd|secret|token|required|hidden|string|text|empty|missing|invalid|default|unknown|example|sample|dummy|change|replace|insert|plain|input|field|label|value|reset|update|verify|forgot|confirm|login")
#: Comments that state a secret: "old token, rotate later: <value>", "works with password <value>".
_REMARK = re.compile(r"(?i)\b(?:password|passwd|secret|token|key|credential)s?\b[^:=\n]{0,60}[:=]\s*([^\s\"'`;,<>(){}]+)\s*$", re.M)
_STATED = re.compile(r"(?i)\b(?:password|passwd|passphrase|secret|token|key|login)\s+(?:is\s+|was\s+)?[\"'`]?([^\s\"'`;,<>(){}]{6,})[\"'`]?(?=[\s.,;)]|$)", re.M)
_SCHEME = re.compile(r"(?i)(basic|bearer|token|apikey|digest)\s+")
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`")
_COMMENT = re.compile(r"^\s*(?:#|//|/?\*|--|;|<!--)|(?<=\s)(?:#|//)\s")
_CONFIG = re.compile(r"(?i)\.(?:env|ini|ya?ml|properties|json|toml|conf|cfg|config|tfvars|xml)$|(?:^|/)\.env|dockerfile")

_PLACEHOLDER = re.compile(
    r"""(?ix)^(?:x+|\*+|\.+|-+|_+|\?+|0+|(?:123)+4?5?6?)$ | ^<.*>$ | ^\[.*\]$ | \$\{|\$\(|\{\{|\}\}|%\(|<%|^\$[A-Za-z_] | ^%\w+%$ | ^!\w+ | ^\{\w*\}$ | ^\#\{
      | xxxx|\*\*\*|placeholder|change[-_ ]?(?:me|it)(?![a-z])|(?<![a-z0-9])(?:replace|insert|redacted|dummy|sample|todo|tbd|fixme)(?![a-z0-9])|(?<![a-z0-9])your[-_ ]|[-_ ]here$|goes[-_ ]here|not[-_ ]?set|set[-_ ]in|from[-_ ](?:env|vault)|^vault[:/]|^env[:.]|^secret[:/]|^arn:|^(?:none|null|nil|true|false|undefined|empty|string|default)$"""
)
_PUBLIC = re.compile(r"(?i)^(?:sha\d*[-:]|md5[-:]|ssh-|ecdsa-|data:|https?:|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-)|-----BEGIN (?!(?:[A-Z0-9]+ )*PRIVATE)")


def looks_secret(value: str, strong: bool = True) -> bool:
    """Whether a literal can be a secret's value and is no placeholder, reference or plain words."""
    if len(value) < 6 or re.search(r"\s", value) or _PLACEHOLDER.search(value) or _PUBLIC.search(value):
        return False
    digit, low, up = (bool(re.search(p, value)) for p in (r"\d", "[a-z]", "[A-Z]"))
    mark = bool(re.search(r"[^\w.:/-]", value))
    if re.fullmatch(r"[A-Z][A-Z_]*", value) or re.fullmatch(r"[\d.,:xX-]+", value) or re.fullmatch(r"(?:[\w.-]+/)+[a-z._-]+", value):
        return False  # a constant's name, a number, a path
    if re.fullmatch(r"[A-Za-z_$][\w$]*(?:(?:\.|::|->)[\w$]+)*\(.*", value) or re.fullmatch(r"[a-z_]\w*(?:\.[a-z_]\w*)+", value):
        return False  # a call, an attribute
    if not strong:
        return len(value) >= 8 and digit and (mark or (low and up) or bool(re.fullmatch(r"[a-z]+(?:-[a-z]+)+-\d+", value)) or len(value) >= 32)
    return digit and (low or up) or mark and (low or up) and len(value) >= 8 or low and up and len(value) >= 12 and not re.fullmatch(r"[A-Z]?[a-z]+(?:[-_]?[A-Z][a-z]+)*", value)


def _random(tail: str) -> bool:
    return bool(re.search(r"\d", tail) and re.search("[a-z]", tail) and re.search("[A-Z]", tail))


def _after(text: str, at: int, name: str, config: bool) -> Iterator[tuple[int, int]]:
    """Spans of the literals that the name before ``at`` is bound to."""
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    strong, line = bool(_STRONG.search(name)), text[at:end].rstrip("\r")
    begin = text.rfind("\n", 0, at) + 1
    comment = _COMMENT.search(text[begin:at])
    if not line.strip(" ([{") and not config:  # the value stands on the next line
        nxt = re.compile(r"\s*[\[({]?\s*").match(text, at).end()
        q = _QUOTED.match(text, nxt)
        if q and text[at:nxt].count("\n") <= 2:
            at, line = nxt, q.group(0)
        else:
            return
    typed = None if comment else re.match(r"&?[A-Za-z_][\w.<>\[\]|? ]*=\s*(?=[\"'`])", line)
    if typed:  # name: type = "value"
        at, line = at + typed.end(), line[typed.end() :]
    first = _QUOTED.match(line)
    if first:
        found = [first]
        rest = line[first.end() :]
        while re.match(r"\s*(?:\|\||\?\?|\?:|or\b)", rest):  # each default behind another
            more = next(_QUOTED.finditer(line, found[-1].end()), None)
            if more is None:
                break
            found.append(more)
            rest = line[more.end() :]
    elif re.match(r"[\w$.:>-]+\s*[(\[.]|\S+\s*(?:\|\||\?\?|\?:|\bor\b)|\$?\w+\(|\(", line) and not (comment or config and not re.match(r"[\w$.:>-]+\(", line)):
        found = list(_QUOTED.finditer(line))  # a default beside a reference
        choice = re.search(r"\|\||\?\?|\?:|\bor\b", line)
        found = [q for q in found if q.start() > choice.start()] if choice else found[-1:] if len(found) > 1 else []
    elif comment or config:
        m = re.match(r"[^\s\"'`;,<>(){}]+", line) if comment else re.match(r"[^\s\"'`;,<>]+", line)
        if m and looks_secret(m.group(0).rstrip(".)"), strong) and not re.match(r"\s*\(", line[m.end() :]):
            yield at, at + len(m.group(0).rstrip(".)"))
        elif m and _SCHEME.match(line):
            v = line[_SCHEME.match(line).end() :].split()
            if v and looks_secret(v[0]):
                yield at + line.index(v[0]), at + line.index(v[0]) + len(v[0])
        return
    else:
        found = []
    for q in found:
        i = next(g for g in (1, 2, 3) if q.group(g) is not None)
        value, s = q.group(i), at + q.start(i)
        scheme = _SCHEME.match(value)
        if scheme:
            value, s = value[scheme.end() :], s + scheme.end()
            if scheme.group(1).lower() == "basic":
                try:
                    inner = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
                except ValueError:
                    continue
                if ":" in inner and looks_secret(inner.split(":", 1)[1]):
                    yield s, s + len(value)
                continue
        if looks_secret(value, strong) or not comment and _PASSWORD.search(name) and re.fullmatch(r"[a-z]{6,}", value) and not _ORDINARY.search(value):
            yield s, s + len(value)


@lru_cache(maxsize=1)
def _automata() -> tuple[Automaton, list[Automaton]]:
    """The automaton of all rules, and each rule read backwards from its end."""
    return Automaton([r.pattern for r in RULES]), [Automaton([r.pattern], anchored=True, backward=True) for r in RULES]


def _final(ends: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, rules) where a rule's match ends for good: one that the next byte makes longer ends there."""
    places, rules = [], []
    for i, rule in enumerate(RULES):
        own = ends[(masks >> i) & 1 == 1]
        if rule.kind != "name" and len(own):
            own = own[np.append(np.diff(own) != 1, True)]
        places.append(own)
        rules.append(np.full(len(own), i))
    at, of = np.concatenate(places), np.concatenate(rules)
    order = np.lexsort((of, at))
    return at[order], of[order]


def _matches(data: bytes, events: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the longest match of each rule at each place where it ends."""
    for e, i in events:
        if RULES[i].kind == "name":
            yield "name", e, e + 1
            continue
        begin = max(data.rfind(b"\n", 0, e) if data[e] != 10 else e, 0)
        n = _automata()[1][i].longest(data[begin : e + 1][::-1])
        if n:
            yield RULES[i].kind, e + 1 - n, e + 1


def _value(kind: str, data: bytes, start: int, end: int) -> tuple[int, int] | None:
    """The span of the value within a match, or null where it is none."""
    if kind in ("token", "word", "prefixed"):
        start += 1  # the byte before it
        value = data[start:end].decode("ascii", "replace")
        if kind == "word" and data[end : end + 1].isalnum() or kind == "prefixed" and (not _random(re.split("[-_]", value)[-1]) or re.match(r"(?i)sha|md5|col|rev|id_|uuid", value)):
            return None
        return None if kind != "prefixed" and _DULL.search(value) else (start, end)
    if kind == "connection":
        start, end = data.index(b":", data.index(b"://", start) + 3) + 1, end - 2
        value = data[start:end].decode("utf-8", "replace")
        return (start, end) if len(value) >= 4 and not _PLACEHOLDER.search(value) and not re.fullmatch(r"(?i)pass(?:word)?|pw|secret", value) else None
    if kind == "element":
        start, end = data.index(b">", start) + 1, end - 2
    else:
        start = data.index(b":", start) + 1  # a login
    return (start, end) if looks_secret(data[start:end].decode("utf-8", "replace")) else None


def _armored(data: bytes, matches: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of private keys, and of public armor, from its first line to its last or the end of the text."""
    out: list[list[tuple[int, int]]] = []
    for kind in ("key", "public"):
        spans, heads, tails = [], sorted(m[1:] for m in matches if m[0] == kind), sorted(m[1:] for m in matches if m[0] == f"{kind} end")
        for start, end in heads:
            if spans and start < spans[-1][1]:
                continue
            tail = next((t for t in tails if t[0] >= end), None)
            inner = data[end : tail[0] if tail else len(data)].decode("utf-8", "replace")
            body = re.sub(r"\\n|\\r|[\s\"'+,#*/>|-]", "", inner)
            if kind == "public" or len(body) >= 20 and re.match(r"[A-Za-z0-9+/=:.]+", body) and not _PLACEHOLDER.search(body[:20]):
                spans.append((start, tail[1] if tail else len(data)))
        out.append(spans)
    return out[0], out[1]


def _named(text: str, hits: list[int], config: bool) -> Iterator[tuple[int, int]]:
    """Spans of the literals bound to names of secrets, on the lines where the automaton ended one."""
    seen = -1
    for h in hits:
        if h <= seen:
            continue
        begin, seen = text.rfind("\n", 0, h) + 1, text.find("\n", h)
        seen = len(text) if seen < 0 else seen
        for m in _NAME.finditer(text, begin, seen):
            if m.group("join") in (",", "(") and not re.search(r"[\"'`][\])]*\s*,|\(\s*$", m.group(0)) and not _COMMENT.search(text[begin : m.start()]):
                continue
            if not _HARMLESS.search(m.group("name")):
                yield from _after(text, m.end(), m.group("name"), config)
        if _COMMENT.search(text[begin:seen]):  # "old token, rotate later: <value>"
            for pattern in (_REMARK, _STATED):
                yield from (m.span(1) for m in pattern.finditer(text, begin, seen) if looks_secret(m.group(1), False))


def located(texts: list[str], configs: list[bool]) -> Iterator[list[tuple[int, int]]]:
    """Per text the spans of the values of its credentials, in characters, in order and apart."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    # each text stands between line ends
    whole = b"\n" + b"\n".join([*coded, b""])
    offsets = 1 + np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]).astype(np.int64)
    ends, rules = _final(*_automata()[0].ends(np.frombuffer(whole, np.uint8)))
    cuts = np.searchsorted(ends, offsets)
    for i, (text, data, config) in enumerate(zip(texts, coded, configs)):
        if cuts[i] == cuts[i + 1]:
            yield []
            continue
        # the line end before the text is a part of it here, so that a match can begin with it
        data = b"\n" + data
        own = slice(cuts[i], cuts[i + 1])
        matches = list(_matches(data, list(zip((ends[own] - offsets[i] + 1).tolist(), rules[own].tolist()))))
        keys, public = _armored(data, matches)
        spans = keys + [v for kind, s, e in matches if kind in ("token", "word", "prefixed", "connection", "login", "element") for v in [_value(kind, data, s, e)] if v]
        place = np.arange(len(data) + 1) if len(data) == len(text) + 1 else np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        as_text = lambda s: max(int(place[s]) - 1, 0)  # noqa: E731, B023
        found = [(as_text(s), as_text(e)) for s, e in spans]
        found += _named(text, sorted(as_text(s) for kind, s, _ in matches if kind == "name"), config)
        hidden = [(as_text(s), as_text(e)) for s, e in public]
        merged: list[tuple[int, int]] = []
        for s, e in sorted(set(found)):
            if any(a <= s and e <= b for a, b in hidden):
                continue
            if merged and s < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        yield merged


#: Texts that are scanned together.
TEXTS = 2000


def _spans(text: Column, path: Column) -> Column:
    """Spans [start, end) with their lines; only the texts go to the Python worker, only the spans come back."""

    @F.pandas_udf("array<struct<start:int,stop:int,line:int>>")
    def scan(texts: pd.Series, configs: pd.Series) -> pd.Series:
        out: list[list[dict]] = []
        for at in range(0, len(texts), TEXTS):
            some = texts.iloc[at : at + TEXTS].tolist()
            for t, own in zip(some, located(some, configs.iloc[at : at + TEXTS].tolist())):
                out.append([{"start": s, "stop": e, "line": t.count("\n", 0, s) + 1} for s, e in own])
        return pd.Series(out, dtype=object)

    return scan(F.coalesce(text, F.lit("")), F.coalesce(path.rlike(_CONFIG.pattern), F.lit(False)))


def scanned(df: DataFrame, key: Column, text: str, path: str) -> DataFrame:
    """(row_key, text, spans): each text with the spans [start, end) and lines of its credentials."""
    return df.select(key.cast("string").alias("row_key"), F.col(text).alias("text"), _spans(F.col(text), F.col(path)).alias("spans"))


def found(df: DataFrame, key: Column, text: str, path: str) -> DataFrame:
    """(row_key, line_no): one row per line on which a credential's value begins."""
    rows = scanned(df, key, text, path).where(F.size("spans") > 0)
    return rows.select("row_key", F.explode("spans.line").alias("line_no")).distinct()


def redacted(df: DataFrame, key: Column, text: str, path: str) -> DataFrame:
    """(row_key, text, n): texts with the values masked and everything else as it was."""
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit(MASK)).alias("out"), s["stop"].alias("at")
        ),
        lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))),
    )
    return scanned(df, key, text, path).select("row_key", F.when(F.size("spans") > 0, pieces).otherwise(F.col("text")).alias("text"), F.size("spans").alias("n"))

"""Splitting source text into tokens of the classes of :mod:`quarrykit.llm.grammar`."""

from __future__ import annotations

from functools import lru_cache

import regex

# Words of the languages with their class (D declaring, R before an operand, W between
# operands, C control, Z block, J jump, V value); words that are names elsewhere are left out.
WORDS = {
    "python": {"D": "global nonlocal import from async", "R": "return raise yield await del assert not lambda", "W": "in is and or as", "C": "def class if while for with elif", "Z": "else", "T": "try", "H": "except finally", "J": "pass break continue", "V": "None True False"},
    "javascript": {"D": "const let var function class export default import async static", "R": "return throw new typeof void delete await yield case", "W": "in of instanceof as from extends", "C": "if for while switch catch with", "Z": "else try finally do", "J": "break continue debugger", "V": "null true false this super undefined"},
    "typescript": {"D": "const let var function class interface type enum namespace declare abstract readonly public private protected export default import async static override", "R": "return throw new typeof void delete await yield case keyof infer unique asserts", "W": "in of instanceof as from extends implements is satisfies", "C": "if for while switch catch with", "Z": "else try finally do", "J": "break continue debugger", "V": "null true false this super undefined"},
    "java": {"D": "public private protected static final abstract class interface enum package import synchronized native transient volatile default strictfp", "R": "return throw new case assert", "W": "instanceof extends implements throws", "C": "if for while switch catch", "Z": "else try finally do", "J": "break continue", "V": "null true false this super"},
    "csharp": {"D": "public private protected internal static readonly abstract sealed class interface enum struct namespace using const override virtual async partial extern event delegate unsafe ref out params default", "R": "return throw new case await typeof sizeof nameof stackalloc", "W": "is as in", "C": "if for foreach while switch catch lock fixed", "Z": "else try finally do checked unchecked", "J": "break continue", "V": "null true false this base"},
    "go": {"D": "package import func type var const struct interface map chan", "R": "return defer go case range", "W": "", "C": "if for switch select", "Z": "else", "J": "break continue fallthrough default", "V": "nil true false"},
    "rust": {"D": "use pub fn struct enum impl trait mod const static type let mut extern unsafe async ref move dyn crate", "R": "return await", "W": "as in where", "C": "if for while match", "Z": "else loop", "J": "break continue", "V": "true false self Self super"},
    "php": {"D": "namespace use class interface trait enum function fn public private protected static final abstract const var readonly global", "R": "return throw new echo print clone case yield require require_once include include_once", "W": "instanceof as extends implements insteadof and or xor", "C": "if for foreach while switch catch elseif match declare", "Z": "else try finally do", "J": "break continue default", "V": "null true false"},
    "ruby": {"D": "alias undef", "R": "return not yield when", "W": "and or in", "C": "elsif rescue", "Z": "else ensure then retry redo", "J": "break next", "V": "nil true false self super"},
}
_FAMILY = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "cs": "csharp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby"}
#: Languages by ending.
ENDINGS = dict(_FAMILY)

_SINGLE = {"(": "LP", ")": "RP", "[": "LB", "]": "RB", "{": "LC", "}": "RC", ",": "COMMA", ";": "SEMI", ":": "COLON", ".": "DOT", "?": "Q", "@": "AT", "#": "HASH", "!": "U", "~": "U", "<": "G", ">": "G", "=": "ASSIGN"}
_OPERAND_END = frozenset("N L V RP RB RC I J".split())
_QUOTED = r"""\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"""
_PYTHON_NUMBER = r"0[xXbBoO][\da-fA-F_]+(?![\w.])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[jJ]?(?!\w)"
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*)(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[a-zA-Z]*(?![\w])"
_OPS = (
    ("E", r"\.\.\.|\.\.=?"), ("ASSIGN", r"(?:\*\*|//|<<|>>>|\?\?|&&|\|\||[-+*/%&|^@:])=(?![=>])"), ("A", r"->|=>"), ("I", r"\+\+|--"),
    ("B", r"===|!==|==|!=|<=>|<=|>=|=~|!~|&&|\|\||\?\?|\?:|<<|\*\*|//|[/%^|]"), ("P", r"[-+*&]"),
)
_MARK = r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)"  # what a merge leaves behind
_SPACE = {
    "python": r"[ \t\f]+|\\\r?\n|\#[^\n]*", "ruby": r"[ \t\r]+|\\\r?\n|\#[^\n]*|^=begin\b.*?^=end[^\n]*", "go": r"[ \t\r]+|//[^\n]*",
    "php": r"\s+|//[^\n]*?(?=\?>|\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\n|\Z)|/\*.*?\*/", "rust": r"\s+|//[^\n]*|(?P<nest>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&nest))*\*/)",
}
_STRING = {
    "python": r"[rRbBuUfFtT]{0,3}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|" + _QUOTED + r"(?![\"']))|[rRbBuUfF]{0,3}(?:\"\"|'')(?![\"'])",
    "javascript": r"`(?:[^`\\]|\\.)*+`|" + _QUOTED, "typescript": r"`(?:[^`\\]|\\.)*+`|" + _QUOTED,
    "java": r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.[0-7a-fA-F]*)'",
    "csharp": r"\$*\"\"\".*?\"\"\"|(?:\$@|@\$?)\"(?:[^\"]|\"\")*+\"|\$?\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'",
    "go": r"`[^`]*+`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'",
    "rust": r"(?:br|r|cr)(?P<h>#*)\".*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*+\"|b?'(?:[^'\\\n]|\\.[^']*)'",
    "php": r"<<<[ \t]*[\"']?(?P<id>\w+)[\"']?\r?\n.*?^[ \t]*(?P=id)\b|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|`[^`]*+`",
    "ruby": r"<<[-~]?[\"'`]?(?P<id>[A-Z_]\w*)[\"'`]?(?=[^\n]*\n)(?P<rest>[^\n]*)\n.*?^[ \t]*(?P=id)\b|\"(?:[^\"\\#]|\\.|#(?!\{)|#(?P<br>\{(?:[^{}]|(?&br))*\}))*+\"|'(?:[^'\\]|\\.)*+'|`[^`\n]*+`|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|\|[^|]*\|)|:\"[^\"\n]*\"|(?<![\w:)\]]):[A-Za-z_]\w*[?!]?",
}
_SLASH = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*"
_NAME = {"php": r"\$?[A-Za-z_\x80-\U0010ffff\\][\w\\]*", "ruby": r"@{0,2}\$?[A-Za-z_]\w*[?!]?(?!=[^=~>])|@{0,2}\$?[A-Za-z_]\w*", "rust": r"'[A-Za-z_]\w*(?!')|r\#[A-Za-z_]\w*|[A-Za-z_]\w*", "javascript": r"#?[\p{L}_$][\p{L}\p{N}_$]*", "typescript": r"#?[\p{L}_$][\p{L}\p{N}_$]*", "csharp": r"@?[\p{L}_]\w*"}
#: Statements of Python that begin with a word which is a name elsewhere.
_SOFT = regex.compile(r"(?:match|case)[ \t]+(?![=.,:)\]]|(?:in|is|and|or|if)\b)[^\n]*:[ \t]*(?:\#[^\n]*)?(?:\r?\n|\Z)|case[ \t]+[^\n]*:|match[ \t]*\([^\n]*\)[ \t]*:|type[ \t]+\w+[^\n]*=")
#: What follows a name but not a word between operands.
_NAMED = regex.compile(r"\s*(?:[.,)=:;\]&|?+]|\Z)")
_INDENT, _GAP, _SLASHED = regex.compile(r"[ \t\f]*"), regex.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", regex.S), regex.compile(_SLASH)
#: What begins an operand on the next line, words that go on with the line before, and numbers as a whole.
_BEGINS, _JOINS = regex.compile(r"[\p{L}\p{N}_$\"'`{@#!~]"), regex.compile(r"(?:in|of|instanceof|as|from|extends|implements|satisfies)\b")
_NUMERAL = regex.compile(r"\.?[\d_.]+(?:[eE][+-]?\d+)?[a-zA-Z]{0,5}\d{0,3}|0[xXbBoO][\da-fA-F_]+\w*")
_OPENERS = frozenset("def class module begin do case".split())
_MODIFIERS = frozenset("if unless while until for".split())


@lru_cache(maxsize=16)
def _pattern(language: str):
    space = _SPACE.get(language, r"\s+|//[^\n]*") + (r"|/\*.*?\*/" if language not in ("python", "ruby", "php", "rust") else "")
    parts = [("X", _MARK), ("_S", space), ("_L", _STRING[language]), ("_O", r"/\*"), ("_N", _PYTHON_NUMBER if language == "python" else _NUMBER if language in ("rust", "ruby") else _NUMBER + r"|(?<![\w)\]])\.\d[\d_]*(?:[eE][+-]?\d+)?[a-zA-Z]?(?!\w)"), ("_W", _NAME.get(language, r"[\p{L}_]\w*"))]
    ops = _OPS if language != "python" else (("ASSIGN", r"(?:\*\*|//|<<|>>|[-+*/%&|^@:])=(?!=)"), ("E", r"\.\.\."), ("A", r"->"), ("B", r"==|!=|<=|>=|<<|>>|\*\*|//|[/%^|&]"), ("P", r"[-+*]"))
    if language in ("javascript", "typescript"):
        ops = tuple((c, p.replace(r"\.\.\.|\.\.=?", r"\.\.\.").replace(r"|\?:", "")) for c, p in ops)
    if language == "php":
        ops = (("DOT", r"\?->|->|::"), *((c, p.replace("->|=>", "=>")) for c, p in ops))
        ops = tuple((c, p.replace(r"[-+*/%&|^@:]", r"[-+*/%&|^@:.]")) for c, p in ops)
    body = "|".join(f"(?P<{n}>{p})" for n, p in [*parts, *ops, ("_1", r"[()\[\]{},;:.?@#!~<>=]")])
    return regex.compile(body if language != "python" else body, regex.S | regex.M), {w: c for c, ws in WORDS[language].items() for w in ws.split()}


def tokens(text: str, language: str) -> list[tuple[str, int]]:
    """(class, line) of all tokens, from BOF to EOF; X stands for what is no token of the language.

    In Python, T stands for ``try`` and H for ``except`` and ``finally``.
    """
    pattern, words = _pattern(language)
    out, at, line, deep, n = [("BOF", 1)], 0, 1, 0, len(text)
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!", at) and language in ("javascript", "typescript", "php", "ruby", "python"):
        end = text.find("\n", at)
        at = n if end < 0 else end
    slashes = _SLASHED if language in ("javascript", "typescript", "ruby") else None
    if language == "php":
        at = text.find("<?php")
        if at < 0:
            return [("BOF", 1), ("EOF", 1)]
        line, at = text.count("\n", 0, at) + 1, at + 5
    indents, opening, last_line, head, loop = [0], True, 1, "", False

    def add(kind: str) -> None:
        out.append((kind, line))

    while at < n:
        last = out[-1][0]
        if language == "python" and opening and deep == 0:  # the indent of a logical line
            m = _INDENT.match(text, at)
            nxt = text[m.end() : m.end() + 1]
            if nxt not in ("\n", "\r", "#", ""):
                width = len(m.group(0).expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    add("INDENT")
                while width < indents[-1]:
                    indents.pop()
                    add("DEDENT")
                if width != indents[-1]:
                    add("X")
            opening = False
            at = m.end()
            continue
        c = text[at]
        if c == "\n" and language in ("python", "go", "ruby") or c == "\r" and language == "python":
            if language == "python":
                if deep == 0 and last not in ("NL", "CNL", "BOF", "INDENT", "DEDENT"):
                    add("CNL" if last == "COLON" else "NL")
                opening = opening or deep == 0
                if text.startswith("\r\n", at):
                    at += 1
            elif language == "go" and (last in ("N", "L", "V", "RP", "RB", "RC", "I", "J") or last == "R" and head == "return"):
                add("SEMI")
            elif language == "ruby" and last not in ("NL", "BOF", "COMMA", "DOT", "P", "ASSIGN") and not (last == "B" and out[-2][0] != "KO" and not head.endswith("|")):
                add("NL")
            elif language == "ruby" and head.endswith("|") and last == "B":
                add("NL")
            line += 1
            at += 1
            loop = False
            continue
        if slashes and c == "/" and last not in _OPERAND_END:
            m = slashes.match(text, at)
            if m:
                add("L")
                at = m.end()
                continue
        m = pattern.match(text, at)
        if m is None:
            add("X")
            at += 1
            continue
        kind, s = m.lastgroup, m.group(0)
        if kind in ("h", "id", "rest", "br", "nest"):
            kind = next(k for k in ("_S", "_L") if m.group(k))
        if not s:
            add("X")
            at += 1
            continue
        if kind == "_S":
            if "\n" in s and language in ("javascript", "typescript") and last in ("N", "L", "V", "RP", "RB", "RC", "J", "I", "R"):
                nxt = _GAP.match(text, m.end()).end()
                if nxt < n and _BEGINS.match(text, nxt) and not _JOINS.match(text, nxt) and not (last in ("RP", "N", "RC") and text[nxt] == "{") and not text.startswith("!=", nxt):
                    add("SEMI")
        elif kind == "_L":
            if language == "ruby" and m.group("rest") is not None:  # the line goes on behind the mark of a heredoc
                add("L")
                for k, _ in tokens(m.group("rest"), "ruby")[1:-1]:
                    add(k)
            else:
                add("L")
        elif kind == "_O":
            add("X")
            at = n
            continue
        elif kind == "_N":
            add("L" if language == "python" or _NUMERAL.fullmatch(s) else "X")
        elif kind == "_W":
            word = s
            if language == "ruby" and last != "DOT" and not text.startswith(":", m.end()) or language == "ruby" and last != "DOT" and text.startswith("::", m.end()):
                if word in _OPENERS and not (word == "do" and loop):
                    add("KO")
                    head = word
                    at = m.end()
                    continue
                if word in _MODIFIERS:
                    starts = last in ("NL", "BOF", "SEMI", "ASSIGN", "LP", "Z", "KO", "COMMA", "B", "RC", "KE") and not (last == "KE") or last == "B"
                    add("KO" if starts else "C")
                    loop = starts and word in ("while", "until", "for")
                    at = m.end()
                    continue
                if word == "end":
                    add("KE")
                    at = m.end()
                    continue
            if language == "python" and word in ("match", "case", "type") and last in ("NL", "INDENT", "DEDENT", "BOF", "CNL") and _SOFT.match(text, at):
                add("D" if word == "type" else "C")
                at, head = m.end(), word
                continue
            known = words.get(word if language != "php" else word.lower())
            if last == "DOT" and language != "python" and not (language == "rust" and word == "await") or language == "ruby" and text.startswith(":", m.end()) and not text.startswith("::", m.end()):
                known = None
            if known == "W" and language in ("javascript", "typescript") and word in ("of", "from", "as", "is") and _NAMED.match(text, m.end()):
                known = None
            add(known or "N")
            head = word
        elif kind == "_1":
            k = _SINGLE[s]
            deep += 1 if s in "([{" else -1 if s in ")]}" and deep else 0
            if language == "python" and s in "!?" or language in ("java", "go") and s == "#" or language in ("java", "php") and s == "~" and False:
                k = "X"
            add(k)
            head = s
        elif kind == "X":
            add("X")
        elif kind == "B" and s.startswith("?>") and language == "php":
            add("SEMI")
        else:
            add(kind)
            head = s
        if language == "php" and text.startswith("?>", m.end()):
            nxt = text.find("<?php", m.end())
            add("SEMI")
            line += text.count("\n", at, nxt if nxt >= 0 else n)
            at = n if nxt < 0 else nxt + 5
            continue
        line += s.count("\n")
        at = m.end()
    if language == "python":
        if deep == 0 and out[-1][0] not in ("NL", "CNL", "BOF", "DEDENT"):
            add("CNL" if out[-1][0] == "COLON" else "NL")
        out.extend([("DEDENT", line)] * (len(indents) - 1))
    elif language == "ruby" and out[-1][0] not in ("NL", "BOF"):
        add("NL")
    elif language == "go" and out[-1][0] in ("N", "L", "V", "RP", "RB", "RC", "I", "J", "R") or language in ("javascript", "typescript") and out[-1][0] in ("N", "L", "V", "RP", "RB", "J"):
        add("SEMI")
    add("EOF")
    return out

"""Small grammars of programming languages over token classes, and the adjacent pairs they permit.

Classes: N name, L literal, V value word, D declaring word, R word before an operand, W word between
operands, C control word, Z block word, J jump, LP RP LB RB LC RC brackets, COMMA SEMI COLON DOT Q,
ASSIGN, B binary operator, P operator of either kind, G angle bracket, U prefix operator, I step, A
arrow, E ellipsis, AT, HASH, KO KE block words that nest, NL CNL INDENT DEDENT lines, BOF, EOF.
"""

from __future__ import annotations

import re

CURLY = """
file  = BOF item* EOF
item  = SEMI | word | word* expr SEMI | word* block | word+ expr block | label
label = N COLON | L COLON | V COLON
word  = D | C | Z | J | R
block = LC any RC
any   = (item | expr sep | sep)* expr?
sep   = COMMA | SEMI
expr  = pre* prim post* (op pre* prim post*)*
op    = B | P | G | W | ASSIGN | A | Q | COLON | COMMA | E
pre   = P | U | I | R | AT | D | C
prim  = N | L | V | LP any RP | LB any RB | LC any RC | D | R
post  = LP any RP | LB any RB | LC any RC | I | G list G | Q? DOT N | Q? DOT D | Q? DOT R | Q? DOT C | Q DOT LB | Q DOT LP
list  = expr (COMMA expr)*
after = RC item | RP item | RC SEMI | Z C | Z Z | D D | J SEMI | R SEMI | RP A | A item | COLON item | RC RC | RP E | G G | G LP | G LC | G COMMA | G SEMI | G RP | G COLON | G ASSIGN | G DOT | W word | ASSIGN word | COMMA RP | COMMA RB | COMMA RC | SEMI RP | LP SEMI | LP RP | LB RB | LC RC | D SEMI | D LC | D LP | D P | D COLON | RC EOF | SEMI EOF | BOF EOF | LC EOF | COLON RC | COLON SEMI | Z LC | C LC | C LP | RC Z | RC C | RC W | RC D | RP D | RP Z | RP C | LP E | LB E | COMMA E | LC E | E N | E LP | E LB | E L | E V | E R | E LC | E D
"""

#: What a language permits besides, as further adjacencies.
EXTRA = {
    "javascript": "more = D N | N A | RC LP | RC N | RB SEMI | D E | U D | N U | Q Q | D W | W LC | HASH N | D L | RP Z | V SEMI | P LC | RC B | D G | W V | W N",
    "typescript": "more = D N | N A | RC LP | RC N | Q COLON | Q COMMA | Q RP | N U | U SEMI | U RP | U DOT | D G | G N | RB N | W LC | W LB | D LB | D E | RB RB | V SEMI | D L | N Q | RB Q | G G | HASH N | LC N | RP COLON | COLON LC | A V | N D | V N | D W | W N | W V | P LC | RC B | RB SEMI",
    "java": "more = N N | G N | RB N | RP N | G G | AT N | N AT | AT D | RP AT | RP D | N E | E N | G LB | LB RB | COLON COLON | N D | RB LC | D G | G D | W N | Q W | Q G | RP L | RP V | RP R | N A | RP LB | Q COMMA | D N | R N | RC N",
    "csharp": "more = N N | G N | RB N | RP N | Q N | G G | N D | RB D | D LB | RB LC | N A | RC ASSIGN | AT N | W N | D N | Q RB | Q G | Q COMMA | Q RP | RP W | LB N | RB LB | N W | N U | U DOT | RP L | RP V | RC N | R LB | R LC | Q Q | HASH N | U SEMI | RB A | RP A | Q LB | Q LC",
    "go": "more = N N | N LB | LB RB | RB N | RB P | RP N | RP LP | RP P | RP LB | RP LC | N P | P N | N D | RB D | RB LB | D D | D N | N LC | N E | E N | E RP | RB LC | D LB | RC LP | L SEMI | RP L | A N | N A | A D | D A | COMMA E | LC SEMI | D L | N L | RP D | SEMI RC | COLON SEMI | DOT LP | DOT L | AT N | L L | LB E | E RB | P D | V SEMI | E D | W LC",
    "rust": "more = SEMI HASH | LC HASH | COMMA HASH | BOF HASH | HASH LB | HASH U | N U | U LP | U LB | U LC | COLON COLON | LC D | RB D | RB N | Q SEMI | Q DOT | Q RP | Q COMMA | Q RC | D D | P D | P L | P B | B N | B B | B P | B LP | B LC | B L | B RC | B COMMA | LP B | COMMA B | ASSIGN B | N LC | RP B | G A | A P | A LP | A V | A N | RP LC | DOT L | E ASSIGN | N E | E N | E L | L E | RB HASH | RC HASH | RP Q | D B | D LP | W P | W N | N W | COLON P | COLON D | B V | B G | G B | Q B | Q P | G P | LB P | B SEMI | D G | RC Q | L A | V A | D N | A LC | RC COMMA | Z LC | N N | RP R | D P | R B | R C | E LP | E RB | B DOT | B E | A J | A R | A D | Q Q | V N | E RC",
    "php": "more = N N | Q N | RP COLON | COLON N | COLON Q | COLON V | N COLON | COLON COLON | AT N | RC LP | N A | A N | RP L | RP N | RP V | D N | W N | D D | G N | Q COLON | U U | V N | N E | E N | P N | P E | RB N | N P | COMMA N | B N | V P | RP R | D L | L SEMI | Q LP | R LP | D V | V B | N B | L G",
}

PYTHON = """
file  = BOF line* EOF
line  = simple NL | simple SEMI | head colon | DEDENT | NL
colon = COLON CNL INDENT | COLON simple NL | COLON simple SEMI
simple= expr | J | R | R expr | D expr | expr ASSIGN expr | AT expr
head  = C expr | C | C N LP any RP A expr | Z | T | H expr | H
any   = (expr sep | sep)* expr?
sep   = COMMA | ASSIGN | COLON | SEMI
expr  = pre* prim post* (op pre* prim post*)* COMMA?
op    = B | P | G | W | ASSIGN | C | Z | COMMA | DOT | W W | COLON | A
pre   = P | U | R | D
prim  = N | L | V | E | LP any RP | LB any RB | LC any RC | L L
post  = LP any RP | LB any RB | DOT N
more  = COMMA B | LP B | LC B | LB B | B COMMA | B RP | P NL | P SEMI | N R | L R | RB R | RP R | RC R | V R | RP D | L D | RB D | V D | N AT | RP AT | RB AT | R RP | N D | DOT D | LP RP | LB RB | LC RC | COMMA RP | COMMA RB | COMMA RC | COMMA NL | COMMA COLON | R COLON | D COLON | LP P | COMMA P | P COMMA | P RP | COLON COLON | LB COLON | COLON RB | COLON COMMA | W U | U W | Z COLON | C C | D D | D C | DOT W | W DOT | DOT DOT | R DOT | D DOT | R NL | J NL | RP NL | RB NL | RC NL | L NL | V NL | N NL | E NL | E LB | W LP | W P | D P | D N | R LP | R W | INDENT T | DEDENT T | NL T | BOF T | DEDENT H | NL H | T COLON | H COLON | H P | H LP | INDENT D | INDENT C | INDENT Z | INDENT R | INDENT J | INDENT N | INDENT L | INDENT V | INDENT E | INDENT AT | INDENT P | INDENT LP | INDENT LB | INDENT LC | DEDENT DEDENT | DEDENT EOF | DEDENT D | DEDENT C | DEDENT Z | DEDENT R | DEDENT J | DEDENT N | DEDENT L | DEDENT V | DEDENT AT | DEDENT LP | DEDENT LB | DEDENT E | NL EOF | NL D | NL C | NL Z | NL R | NL J | NL N | NL L | NL V | NL E | NL AT | NL LP | NL LB | NL LC | NL P | NL DEDENT | CNL INDENT | BOF EOF | BOF NL | COMMA SEMI | P COLON | R C | D L | E RP | E RB | E COMMA | C R | R R | W R | ASSIGN R | COLON R | LP R | COMMA R | COMMA D | LP D | LB D | C P | NL U | LP E | LB E | U LP | W C | COLON D | U U | W D | B R | A R | E DOT | E EOF | NL INDENT | A L | A V | SEMI NL
"""

RUBY = """
file  = BOF line* EOF
line  = stmt NL | stmt SEMI | NL | KE
stmt  = word* body?
word  = D | C | Z | J | R | KO
body  = expr
any   = (expr sep | stmt sep | sep)* stmt?
sep   = COMMA | NL | SEMI
expr  = pre* prim post* (op pre* prim post*)* COMMA?
op    = B | P | G | W | ASSIGN | A | Q | COLON | COMMA | DOT | C | E
pre   = P | U | R | E | C | KO
prim  = N | L | V | LP any RP | LB any RB | LC any RC | LC B names B any RC | A LC any RC
names = (N | COMMA | P | LP | RP)*
post  = LP any RP | LB any RB | LC any RC | KO | Q | U | LC B
more  = LP RP | LB RB | LC RC | COMMA RP | COMMA NL | COMMA RB | COMMA RC | NL RC | NL RP | NL RB | LC NL | LP NL | LB NL | KO NL | KO B | B N | N B | B NL | KO N | KO D | KE NL | KE EOF | KE DOT | KE KE | KE RP | KE C | KE W | NL KE | NL EOF | NL NL | N N | N L | N V | N LB | N U | N COLON | COLON N | COLON L | COLON V | COLON LB | COLON LC | COLON NL | COLON COLON | COLON R | COLON COMMA | COLON RP | L N | D N | D V | D LP | N NL | L NL | V NL | RP NL | RB NL | RC NL | Z NL | J NL | R NL | D NL | U NL | Q NL | KO KO | KO L | KO V | KO P | KO U | KO LP | KO LB | KO R | KO J | KO C | NL DOT | W NL | ASSIGN NL | B P | B LP | B RC | B R | N R | RP C | KO KE | Z KE | NL D | NL C | NL Z | NL R | NL J | NL KO | NL N | NL L | NL V | NL P | NL LB | NL LP | NL LC | BOF NL | BOF EOF | R C | J C | N KO | RP KO | RB KO | C NL | Q N | DOT LP | P RP | P COMMA | P B | N A | A N | A LP | A LC | A L | L A | V A | N P | KO Z | Z N | Z R | Z J | SEMI KE | D D | L L | L COLON | N Q | COMMA LC | COLON A | D L | KE COMMA | KE RC | KO NL | KO G | G N | D G | G V | C V | Q LP | U LP | RP U | KE P
"""

_BASE = {"python": PYTHON, "ruby": RUBY}
LANGUAGES = ("python", "ruby", *EXTRA)


def _parse(text: str):
    """A right-hand side as nested ("seq" | "alt", [...]) and ("rep", x, nullable) nodes."""
    tokens = re.findall(r"[A-Za-z]+|[()|*?+]", text)
    at = 0

    def alt():
        nonlocal at
        options = [seq()]
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            options.append(seq())
        return ("alt", options)

    def seq():
        nonlocal at
        parts = []
        while at < len(tokens) and tokens[at] not in "|)":
            if tokens[at] == "(":
                at += 1
                part = alt()
                at += 1
            else:
                part = tokens[at]
                at += 1
            while at < len(tokens) and tokens[at] in "*?+":
                part = ("rep", part, tokens[at])
                at += 1
            parts.append(part)
        return ("seq", parts)

    return alt()


def permitted(language: str) -> set[tuple[str, str]]:
    """All pairs of classes that can stand side by side in some sentence of the language's grammar."""
    text = _BASE.get(language, CURLY + EXTRA.get(language, ""))
    rules = {name: _parse(right) for name, right in (map(str.strip, line.split("=", 1)) for line in text.strip().splitlines())}
    first: dict[str, set] = {r: set() for r in rules}
    last: dict[str, set] = {r: set() for r in rules}
    empty: dict[str, bool] = {r: False for r in rules}
    pairs: set[tuple[str, str]] = set()

    def walk(node) -> tuple[set, set, bool]:
        if isinstance(node, str):
            return (first[node], last[node], empty[node]) if node in rules else ({node}, {node}, False)
        if node[0] == "alt":
            parts = [walk(x) for x in node[1]]
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        if node[0] == "rep":
            f, t, e = walk(node[1])
            if node[2] != "?":
                pairs.update((a, b) for a in t for b in f)
            return set(f), set(t), e or node[2] != "+"
        f: set = set()
        ends: set = set()
        nothing = True
        for x in node[1]:
            xf, xl, xe = walk(x)
            pairs.update((a, b) for a in ends for b in xf)
            if nothing:
                f |= xf
            ends = (ends | xl) if xe else set(xl)
            nothing = nothing and xe
        return f, ends, nothing

    size = -1
    while size != (size := len(pairs) + sum(map(len, first.values())) + sum(map(len, last.values())) + sum(empty.values())):
        for r, node in rules.items():
            f, t, e = walk(node)
            first[r] |= f
            last[r] |= t
            empty[r] |= e
    return pairs

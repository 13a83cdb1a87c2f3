"""Generated, minified, copied-in and data files, by grammars over their tokens.

Every file's tokens are compressed by Re-Pair: the most frequent adjacent pairs become rules, round
after round.  A short grammar with much reused rules tells a generator, literals that hardly
compress tell a blob, and rules that files of several repositories share tell a copy.  What a
head comment, the path, the size and the line lengths say is held against it.

Defined results: null and empty sources are hand-written unless their path alone decides; null
paths, languages and sizes are read as absent; repeated rows of a file count once; rules are
shared only between different repositories (null is one of them).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.session import cut, spread

_HASH = r"|\#(?!\[)[^\n]*"
_FORMS = r"""(?P<c>//[^\n]*%s|/\*.*?(?:\*/|\Z))|(?P<s>\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)|(?P<n>\d[\w.]*)|(?P<w>[^\W\d]\w*)|(?P<p>[^\s\w])"""
_TOKEN, _TOKEN_PLAIN = re.compile(_FORMS % _HASH, re.S), re.compile(_FORMS % "", re.S)
#: Endings and languages in which ``#`` begins no comment.
NO_HASH = ("js", "mjs", "jsx", "ts", "tsx", "java", "go", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "kt", "swift", "scala", "javascript", "typescript", "rust", "c++", "csharp", "c#", "kotlin")
#: Files whose grammars are inferred side by side.
FILES = 256
#: Rules whose expansion is at least so long take part in the search for copies.
LONG = 24
#: Grammar size against tokens below which a file of at least so many tokens is generated.
REUSE, TOKENS = 0.2, 120
#: Share of a file's characters in literals (documentation aside) from which it is data, and its least size; the grammar
#: of the literals' characters is at least so large against them, or that of the tokens so small.
LITERALS, DATA, PACKED, TABLE = 0.6, 1200, 0.62, 0.2
#: Mean and longest line from which code whose names repeat (grammar of at most DENSE) is minified.
LINE, LONGEST, DENSE = 150, 400, 0.35
#: Share of a file's tokens under rules of other repositories from which it is a copy, and its least tokens.
SHARED, COPY = 0.6, 80

# Words by which tools mark what they write, and where foreign code is kept.
_MADE = re.compile(
    r"(?i)code generated (?:by|from)|@generated|<auto-?generated|auto-?generated (?:file|by|on|from|code)|(?:automatically|machine)[- ](?:generated|made|written)|"
    r"generated (?:by|from|with|using) \S+|do not (?:edit|modify|change)(?: (?:this file|by hand|manually|directly))?[.;!]?\s*$|this file (?:is|was) (?:generated|produced|created) (?:by|from)|changes (?:to this file )?will be (?:lost|overwritten)|produced by a tool",
    re.M,
)
_FOREIGN = re.compile(r"(?i)(?:^|/)(?:third[_-]?party|vendor|_vendor|vendored|node_modules|bower_components|site-packages|dist-packages|godeps|external|externals|jspm_packages|carthage|pods|\.yarn)/")
_LICENSED = re.compile(r"(?i)@license\b|released under the .{2,20} licen[cs]e|licensed under|\b(?:MIT|BSD-\d-Clause|Apache-2\.0|ISC|MPL-2\.0|GPL|LGPL)\b|\(c\) ?\d{4}|copyright (?:\(c\) )?\d{4}")
_VERSION = re.compile(r"(?im)^[\s/*#!;-]*(?:@license\s+)?[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?(?:\s+-\s+https?://\S+)?\s*$")
_OUTPUT = re.compile(r"(?i)(?:\.min\.(?:js|css)|\.bundle\.js|(?:^|/)bundle(?:\.\w+)?\.js|\.(?:pb|g|designer|generated|gen)\.\w+|_(?:generated|pb2|pb2_grpc|gen)\.\w+|\.pb\.go|_string\.go|\.(?:pb\.(?:cc|h)))$")


class Tokens(NamedTuple):
    """The tokens of one text."""

    kinds: list[str]  # names and literals abstract
    words: list[int]  # checksums of the tokens themselves
    head: str  # the comments before the first token
    literals: str  # the literals, documentation aside


def tokens(text: str, hashes: bool = True) -> Tokens:
    """Tokens of a text; ``hashes`` tells whether ``#`` begins a comment in its language."""
    kinds, words, literals, head, began = [], [], [], [], False
    for m in (_TOKEN if hashes else _TOKEN_PLAIN).finditer(text):
        kind, s = m.lastgroup, m.group(0)
        if kind == "c" or (not began and kind == "s" and s.startswith(('"""', "'''"))):
            if not began:
                head.append(s)
            continue
        if kind == "n" or kind == "s" and not s.startswith(('"""', "'''")):
            literals.append(s)
        if s not in ("<", "?", "php", ">"):
            began = True
        kinds.append(s if kind == "p" or s in _KEPT else kind)
        words.append(zlib.crc32(s.encode("utf-8", "replace")))
    return Tokens(kinds, words, "\n".join(head), "".join(literals))


#: Words of programming languages that stay as they are.
_KEPT = frozenset(
    "def class return if else elif for while in is not and or import from as with try except finally raise lambda yield async await pass func fn function var let const type struct "
    "interface package public private protected static final void int new export default use pub impl mod match namespace using partial extends implements this self null None nil true false end do require".split()
)


class Grammar(NamedTuple):
    """Re-Pair grammars of many sequences: what is left of each, its rules, and the rules' uses."""

    values: np.ndarray  # the terminal behind each of the first symbols; the rules' symbols follow
    left: np.ndarray  # the two symbols of each rule
    right: np.ndarray
    rest: np.ndarray
    of: np.ndarray  # the sequence of each symbol in ``rest``
    owner: np.ndarray  # the sequence of each rule
    uses: np.ndarray  # how often each rule stands in the rest and in other rules
    length: np.ndarray  # tokens under each symbol of ``rest``
    digest: np.ndarray  # a hash of what each symbol of ``rest`` stands for

    def size(self, n: int) -> np.ndarray:
        """Symbols of each of ``n`` grammars: the rest and two for each rule."""
        return np.bincount(self.of, minlength=n) + 2 * np.bincount(self.owner, minlength=n)


_U = np.uint64
_mix = lambda x: ((x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)) ^ (x >> _U(17))


def grammar(sequences: list[list[int]] | list[np.ndarray]) -> Grammar:
    """Re-Pair of many sequences side by side, in rounds that replace all locally most frequent pairs.

    Pairs are counted within their sequence; the rules of one know nothing of the others.
    """
    seq = np.concatenate([np.asarray(x, np.int64) for x in sequences]) if sequences else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(sequences)), [len(x) for x in sequences])
    values, seq = np.unique(seq, return_inverse=True)
    digest, length = [_mix(values.astype(np.uint64) + _U(1))], [np.ones(len(values), np.int64)]
    base, owner, uses, lefts, rights = len(values), [], [], [], []
    while len(seq) > 1:
        same = of[:-1] == of[1:]
        keys, inverse = np.unique((of[:-1] * base + seq[:-1]) * base + seq[1:], return_inverse=True)
        count = np.bincount(inverse[same], minlength=len(keys))
        p = np.where(same, count[inverse], 0)
        take = (p >= 2) & (p >= np.concatenate([[0], p[:-1]])) & (p >= np.concatenate([p[1:], [0]]))
        # of neighbours that both could be taken, every second one from the start of the run
        at = np.arange(len(take))
        take &= (at - np.maximum.accumulate(np.where(~take, at, -1)) - 1) % 2 == 0
        taken = np.bincount(inverse[take], minlength=len(count))
        take &= taken[inverse] >= 2
        at = np.flatnonzero(take)
        if not len(at):
            break
        fresh, first, number = np.unique(inverse[at], return_index=True, return_inverse=True)
        left, right = seq[at[first]], seq[at[first] + 1]
        known, size = np.concatenate(digest), np.concatenate(length)
        digest = [known, _mix(known[left] * _U(31) + known[right])]
        length = [size, size[left] + size[right]]
        lefts.append(left), rights.append(right)
        owner.append(of[at[first]])
        uses.append(taken[fresh])
        seq = seq.copy()
        seq[at] = base + number
        base += len(fresh)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, of = seq[keep], of[keep]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Grammar(values, join(lefts), join(rights), seq, of, join(owner), join(uses), np.concatenate(length)[seq], np.concatenate(digest)[seq])


def long_rules(g: Grammar, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, lengths, sequences) of rules of at least ``long`` tokens.

    What Re-Pair leaves, pairs that stand once in their file, is paired on by content: neighbours
    whose pair has the least hash among its neighbours, level by level, so that equal stretches of
    different files end in equal rules.  Each stretch stands under its longest rule.
    """
    h, size, of, most = g.digest, g.length, g.of, _U(2**64 - 1)
    while len(h) > 1:
        pair = _mix(h[:-1] * _U(31) + h[1:])
        open_ = (of[:-1] == of[1:]) & (size[:-1] + size[1:] <= 4 * long)
        rank = np.where(of[:-1] == of[1:], pair, most)
        take = np.flatnonzero(open_ & (rank < np.concatenate([[most], rank[:-1]])) & (rank < np.concatenate([rank[1:], [most]])))
        if not len(take):
            break
        h, size = h.copy(), size.copy()
        h[take], size[take] = pair[take], size[take] + size[take + 1]
        keep = np.ones(len(h), bool)
        keep[take + 1] = False
        h, size, of = h[keep], size[keep], of[keep]
    big = size >= long
    return h[big], size[big], of[big]


_SCHEMA = (
    "repo string, path string, n int, grammar double, reuse int, literals double, packed double, chars bigint, mean_line double, longest int, made boolean, licensed boolean, rules array<bigint>, sizes array<int>"
)


def _profiles(files: pd.DataFrame) -> pd.DataFrame:
    """The profile of some files: three grammars each, of abstract tokens, of the tokens themselves and of literals' characters."""
    texts = files["text"].fillna("").tolist()
    found = [tokens(t, bool(h)) for t, h in zip(texts, files["hashes"])]
    names: dict[str, int] = {}
    count, n = len(texts), np.array([len(f.kinds) for f in found], np.int64)
    kinds = grammar([[names.setdefault(k, len(names)) for k in f.kinds] for f in found])
    reuse = np.zeros(count, np.int64)
    np.maximum.at(reuse, kinds.owner, kinds.uses)
    solid = np.array([max(len("".join(t.split())), 1) for t in texts])
    share = np.array([len(f.literals) for f in found]) / solid
    # only where literals are most of a text their characters tell something
    dense = [np.frombuffer(f.literals.encode("utf-8", "replace"), np.uint8) if s >= LITERALS else np.zeros(0, np.uint8) for f, s in zip(found, share)]
    packed = grammar(dense).size(count) / np.maximum([len(x) for x in dense], 1)
    h, size, of = long_rules(grammar([f.words for f in found]))
    bounds = np.searchsorted(of, np.arange(count + 1))
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    tops = ["\n".join([f.head, *t.split("\n", 3)[:3]]) for f, t in zip(found, texts)]
    rows = {
        "n": n, "grammar": kinds.size(count) / np.maximum(n, 1), "reuse": reuse, "literals": share, "packed": packed, "chars": np.where(files["text"].isna(), files["stated"].fillna(0).clip(lower=0), [len(t) for t in texts]),
        "mean_line": [len(t) / max(len(x), 1) for t, x in zip(texts, lines)], "longest": [max(map(len, x), default=0) for x in lines], "made": [bool(_MADE.search(f.head)) for f in found],
        "licensed": [bool(_LICENSED.search(t) and _VERSION.search(f.head)) for t, f in zip(tops, found)],
        "rules": [h[s:e].astype(np.int64).tolist() for s, e in zip(bounds, bounds[1:])], "sizes": [size[s:e].tolist() for s, e in zip(bounds, bounds[1:])],
    }
    return pd.concat([files[["id", "repo", "path"]], pd.DataFrame(rows, index=files.index)], axis=1)


def profile(df: DataFrame, id: str = "file_id", path: str = "file_path", source: str = "source", repo: str = "repo_url", language: str = "language", size: str = "size_bytes") -> DataFrame:
    """Per file: tokens, grammar size and reuse, literal share and the size of its grammar, lines, head marks, long rules."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), FILES):
                yield _profiles(b.iloc[s : s + FILES])

    # of a file that is written several times the longest text, and among those the greatest stated size
    rank = F.struct(F.coalesce(F.length(source), F.lit(-1)), F.coalesce(F.col(size), F.lit(-1)))
    row = F.struct(F.col(repo).alias("repo"), F.col(path).alias("path"), F.lower(F.trim(language)).alias("language"), F.col(size).alias("stated"), F.col(source).alias("text"))
    files = df.groupBy(F.col(id).alias("id")).agg(F.max_by(row, rank).alias("f")).select("id", "f.*")
    ending = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    # the ending tells the language; without one, what is stated
    files = files.withColumn("hashes", ~F.coalesce(F.when(ending != "", ending), F.col("language"), F.lit("")).isin(*NO_HASH))
    files = spread(files, "id")
    kind = dict(files.dtypes)["id"]
    return files.select("id", "repo", "path", "stated", "text", "hashes").mapInPandas(read, f"id {kind}, {_SCHEMA}")


def judged(df: DataFrame, id: str = "file_id", path: str = "file_path", source: str = "source", repo: str = "repo_url", language: str = "language", size: str = "size_bytes") -> DataFrame:
    """(id, reason, evidence, shared, ...): every file with the reason why it is not hand-written, or null, and all that tells so.

    ``evidence`` lists reuse (a short grammar), literals (near-incompressible or in a table), layout
    (dense code on long lines), shared (rules of other repositories), mark (words of a tool at the
    head), licence (a version and a licence at the head) and path.
    """
    files = cut(profile(df, id, path, source, repo, language, size))  # read three times below
    rules = files.select("id", "repo", F.explode(F.arrays_zip("rules", "sizes")).alias("r")).select("id", F.coalesce("repo", F.lit("")).alias("repo"), F.col("r.rules").alias("rule"), F.col("r.sizes").alias("size"))
    # a rule belongs to several repositories; two aggregates with map-side combine, no pairs of files
    common = rules.groupBy("rule").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("rule")
    shared = rules.join(common, "rule", "left_semi").groupBy("id").agg(F.sum("size").alias("shared_tokens"))
    rows = files.drop("rules", "sizes").join(shared, "id", "left").withColumn("shared", F.coalesce(F.col("shared_tokens") / F.greatest("n", F.lit(1)), F.lit(0.0)))
    where = F.coalesce(F.col("path"), F.lit(""))
    dense = (F.col("literals") >= LITERALS) & (F.col("chars") >= DATA)
    signs = {
        "reuse": (F.col("grammar") < REUSE) & (F.col("n") >= TOKENS) & ~dense,
        "literals": dense & ((F.col("packed") >= PACKED) | (F.col("grammar") < TABLE)),
        "layout": (F.col("mean_line") > LINE) & (F.col("longest") > LONGEST) & (F.col("grammar") < DENSE) & (F.col("n") >= TOKENS) & ~dense,
        "shared": (F.col("shared") >= SHARED) & (F.col("n") >= COPY),
        "mark": F.col("made"), "licence": F.col("licensed"), "output path": where.rlike(_OUTPUT.pattern), "foreign path": where.rlike(_FOREIGN.pattern),
    }
    rows = rows.withColumn("evidence", F.filter(F.array(*[F.when(v, k) for k, v in signs.items()]), lambda x: x.isNotNull()))
    has = lambda *k: F.arrays_overlap("evidence", F.array(*map(F.lit, k)))
    reason = (
        F.when(has("mark", "output path"), "generated").when(has("foreign path", "shared", "licence"), "copied")
        .when(has("literals"), "data").when(has("layout"), "minified").when(has("reuse"), "generated")
    )
    return rows.withColumn("reason", reason)

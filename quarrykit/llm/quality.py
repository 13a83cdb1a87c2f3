"""Per-document text statistics, their place in the language's distribution, and what is no prose.

Statistics are built-in expressions over the whole text.  Per language each statistic has a
mergeable KLL sketch.  From the sketch's quantiles come the point where the distribution's tail
parts from its body (the cut of the greatest variance between both), and the median and spread of the
body; a document's values become percentiles and robust z-scores against the body.  A document
is no prose where its share of characters outside of running sentences lies in the tail of its
language; no share is fixed beforehand.

Defined results: null, empty and blank texts have no words, null ratios and are never flagged; a
null, unknown or wrong language only changes the distribution a document is held against (all
languages without common words share one); repeated texts each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.session import cut

#: Statistics that get a sketch.
STATISTICS = ("mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "common_words", "words_per_unit", "loose_share")
#: Robust standard deviations from the body's median beyond which a value lies in a tail, and the least spread.
TAIL, SPREAD = 3.5, 0.01
#: Share of the variance that a cut must explain, between body and tail, for a distribution to have two parts.
PARTED = 0.8
#: Least share of common words and of letters in running text, and its least number of words.
COMMON, LETTERS, WORDS = 0.18, 0.72, 4
PERCENTILES = 100
#: Most common words that are taken.
WORD_BOUND = 5000

_MARKER = r"(?:[-*+•·▪◦‣–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])[ \t\u00a0]+\S"
_RECORD = r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|[0-9a-fA-F]{6,16}[: ]|(?:at|File|Traceback|Caused by:)[ \t]+\S"
_CODE = r"//|/\*|\*/|\*[ \t]|--[ \t]|\x22\x22\x22|'''|#|\||\+[-=]{2}|</?[a-zA-Z!]"
#: A line that stands for itself, by its beginning; other lines of a paragraph belong together.
HARD = rf"(?:[ ]{{2,}}|\t|[ ]?(?:{_MARKER}|{_RECORD}|{_CODE}))"


def _units(text: Column) -> Column:
    """Paragraphs with their lines joined, and lines that stand for themselves."""
    t = F.regexp_replace(text, r"\r\n?|\u2028|\u2029", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^[ \t]*(?:> ?)+", ""), r"^\s+|\s+$", "")
    return F.split(F.regexp_replace(t, rf"(?<=\S)[ \t]*\n(?!\s*\n|{HARD})", " "), "\n")


def _solid(text: Column) -> Column:
    """Number of characters that are no blanks."""
    return F.length(F.translate(text, " \t\n\x0b\f\r", ""))


def statistics(df: DataFrame, id: str, text: str, lang: str, common: list[str]) -> DataFrame:
    """(id, lang, words and the STATISTICS) of every document; ``common`` holds the common words in small letters."""
    t = F.coalesce(F.col(text), F.lit(""))
    # one pass over the units: the words of a unit are taken out once, everything else is counted on them
    unit = lambda u, w: F.struct(
        _solid(u).alias("solid"), F.size(w).alias("words"), F.size(F.filter(w, lambda x: x.isin(common))).alias("usual"), F.length(F.array_join(w, "")).alias("letters"), u.rlike("^" + HARD).alias("hard")
    )
    base = df.select(
        F.col(id).alias("_q_id"), F.lower(F.col(lang)).alias("_q_lang"), t.alias("_q_t"), F.filter(F.split(t, r"\r\n?|\n"), lambda u: u.rlike(r"\S")).alias("_q_l"),
        F.transform(
            F.filter(_units(t), lambda u: F.length(F.trim(u)) > 0), lambda u: F.transform(F.array(F.filter(F.split(F.lower(u), r"\P{L}+"), lambda w: w != "")), lambda w: unit(u, w))[0]
        ).alias("_q_u"),
    )
    loose = lambda u: u["hard"] | (u["words"] < WORDS) | (u["usual"] < u["words"] * COMMON) | (u["letters"] < u["solid"] * LETTERS)
    sums = F.aggregate(
        "_q_u", F.struct(*[F.lit(0).alias(c) for c in ("solid", "words", "usual", "letters", "loose")]),
        lambda a, u: F.struct(*[(a[c] + u[c]).alias(c) for c in ("solid", "words", "usual", "letters")], (a["loose"] + F.when(loose(u), u["solid"]).otherwise(0)).alias("loose")),
    )
    ended = F.size(F.filter("_q_l", lambda u: u.rlike(r"[.!?…:;。][\"'»”)\]]*\s*$")))
    digits = F.length(F.regexp_replace("_q_t", r"\P{N}+", ""))
    base = base.select("_q_id", "_q_lang", sums.alias("s"), F.size("_q_l").alias("lines"), F.size("_q_u").alias("units"), ended.alias("ended"), digits.alias("digits"))
    part = lambda a, b: F.when(b > 0, a / b)
    solid, n, letters = F.col("s.solid"), F.col("s.words"), F.col("s.letters")
    return base.select(
        F.col("_q_id").alias(id), F.col("_q_lang").alias("lang"), n.cast("bigint").alias("words"), "lines",
        part(letters, n).alias("mean_word_length"), part(F.greatest(solid - letters - F.col("digits"), F.lit(0)), solid).alias("symbol_ratio"), part(F.col("digits"), solid).alias("digit_ratio"),
        part(F.col("ended"), F.col("lines")).alias("ended_lines"), part(F.col("s.usual"), n).alias("common_words"),
        part(n, F.col("units")).alias("words_per_unit"), part(F.col("s.loose"), solid).alias("loose_share"),
    )


def cuts(sketches: DataFrame, group: str) -> DataFrame:
    """One row per group, and per statistic q_: its percentiles, c_: cut between body and tail, m_, d_: the body's median and spread.

    The cut is the quantile that explains most of the variance by two parts.  Where it explains less
    than PARTED, there is one part: the body is everything, and its tail begins TAIL spreads above
    the median.  The share of loose text has two parts only where one lies below a half and the other
    above; with one part, which may be all prose or none, the half itself is the cut.
    """
    ranks = F.array(*[F.lit(i / PERCENTILES) for i in range(PERCENTILES + 1)])
    grid = [F.struct(F.lit(s).alias("s"), F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, ranks)).alias("q")) for s in STATISTICS]
    rows = sketches.select(group, F.explode(F.array(*grid)).alias("_q_x")).select(group, "_q_x.*").where("q is not null")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("mean", total(F.col("q")) / F.size("q"))
    gain = F.transform(F.sequence(F.lit(0), F.lit(PERCENTILES - 1)), lambda i: F.struct(_between(F.col("q"), i, F.col("mean")).alias("gain"), i.alias("i")))
    rows = rows.withColumn("best", F.array_max(gain)).withColumn("variance", total(F.transform("q", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / F.size("q"))
    i, loose = F.col("best.i"), F.col("s") == "loose_share"
    at = lambda n: F.element_at("q", n.cast("int"))
    halves = (at(F.floor(i / 2) + 1) < 0.5) & (at(F.floor((i + 1 + PERCENTILES) / 2) + 1) > 0.5)
    rows = rows.withColumn("two", (F.col("variance") > 0) & (F.col("best.gain") >= PARTED * F.col("variance")) & (~loose | halves))
    # the body is the greater of two parts
    low = F.col("two") & (i < PERCENTILES // 2)
    rows = rows.withColumn("from", F.when(low, i + 1).otherwise(0)).withColumn("to", F.when(F.col("two") & ~low, i).otherwise(PERCENTILES))
    body = lambda share: at(F.col("from") + F.floor((F.col("to") - F.col("from")) * share) + 1)
    # 90 per cent of a normal body lie within 1.645 standard deviations
    rows = rows.withColumn("m", body(0.5)).withColumn("d", F.greatest((body(0.95) - body(0.05)) / 3.29, F.lit(SPREAD)))
    rows = rows.withColumn("c", F.when(F.col("two"), (at(i + 1) + at(i + 2)) / 2).when(loose, 0.5).otherwise(F.col("m") + TAIL * F.col("d")))
    return rows.groupBy(group).agg(*[F.max(F.when(F.col("s") == s, F.col(c))).alias(f"{c}_{s}") for s in STATISTICS for c in ("q", "m", "d", "c")])


def _between(q: Column, i: Column, mean: Column) -> Column:
    """Variance between the percentiles up to number ``i`` (from 0) and those above."""
    below = (i + 1) / F.lit(PERCENTILES + 1)
    part = F.aggregate(F.slice(q, F.lit(1), i + 1), F.lit(0.0), lambda a, v: a + v) / (i + 1)
    return below / (1 - below) * (part - mean) * (part - mean)


def scored(df: DataFrame, common_words: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The statistics with percentiles (p_...), robust z-scores (z_...), ``tail`` and ``no_prose``."""
    # common words are a fixed table of a few hundred rows; it is held to that bound
    rows = common_words.select("lang", F.lower("word").alias("word")).where("word is not null").distinct().limit(WORD_BOUND + 1).collect()
    if len(rows) > WORD_BOUND:
        raise ValueError(f"more than {WORD_BOUND} common words")
    stats = statistics(df, id, text, lang, sorted({r.word for r in rows}) or [""])
    known = sorted({r.lang for r in rows if r.lang})
    # the statistics are few numbers a document, but dear: worked out once, for the sketches and for the scores
    stats = cut(stats.withColumn("_q_g", F.when(F.col("lang").isin(known), F.col("lang")).otherwise("other")))
    grid = cuts(stats.groupBy("_q_g").agg(*[F.kll_sketch_agg_double(s).alias(s) for s in STATISTICS]), "_q_g")
    rows = stats.join(F.broadcast(grid), "_q_g")  # one row per language of the fixed table, and one more
    out = []
    for s in STATISTICS:
        out.append((F.size(F.filter("q_" + s, lambda x: x <= F.col(s))) - 1).alias("p_" + s))  # noqa: B023
        out.append(((F.col(s) - F.col("m_" + s)) / F.col("d_" + s)).alias("z_" + s))
    rows = rows.select(id, "lang", "words", "lines", *STATISTICS, *out, F.coalesce(F.col("loose_share") > F.col("c_loose_share"), F.lit(False)).alias("no_prose"))
    tail = F.greatest(*[F.abs(F.coalesce("z_" + s, F.lit(0.0))) for s in STATISTICS]) > TAIL
    return rows.withColumn("tail", tail)

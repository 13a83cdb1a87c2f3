"""Source files that are not valid in the language of their path.

Files are lexed into rows of tokens.  Adjacent pairs are held against the pairs that the
language's grammar permits; bracket nesting and statement productions are validated with windows
over the rows of a file.  Texts are lexed where they are read, one row of tokens per file is shuffled, and
all windows keep that partitioning: there is no shuffle of single tokens.

Defined results: null and empty sources and endings of unknown languages are not checked; PHP
without an opening tag is plain output and valid; repeated rows of a file count once; a null
repository or language is a group of its own in the rates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm import grammar, lexer
from quarrykit.session import spread

_BRACKETS = {"LP": "RP", "LB": "RB", "LC": "RC", "KO": "KE"}
#: Classes that can begin a declaration at the top of a file, for languages without statements there.
TOP = {
    "go": ("D", "SEMI", "EOF"), "java": ("D", "AT", "SEMI", "EOF"), "csharp": ("D", "LB", "HASH", "SEMI", "EOF", "AT"),
    "rust": ("D", "HASH", "SEMI", "EOF", "N"),
}


def language_of(path: str):
    """The language that the ending of a path names, else null."""
    ending = F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in lexer.ENDINGS.items() for x in kv]), ending)


def tokens(df: DataFrame, id: str = "file_id", path: str = "file_path", source: str = "source") -> DataFrame:
    """(id, tongue, pos, kind, line): the tokens of every file that can be checked."""

    @F.pandas_udf("string")
    def lex(texts: pd.Series, tongues: pd.Series) -> pd.Series:
        # as text, since lists of objects for a whole batch of files would fill the worker
        return pd.Series([" ".join(f"{k},{n}" for k, n in lexer.tokens(t, g)) for t, g in zip(texts, tongues)])

    files = df.where(F.length(source) > 0).select(F.col(id).alias("_q_id"), language_of(path).alias("tongue"), F.col(source).alias("_q_text")).where("tongue is not null")
    # lexed where they are read: what moves is one row per file, and the partitioning by file holds for all that follows
    lexed = spread(files.select("_q_id", F.struct("tongue", lex("_q_text", "tongue").alias("t")).alias("f"), F.length("_q_text").alias("n")), "_q_id")
    files = lexed.groupBy("_q_id").agg(F.max_by("f", "n").alias("f")).select("_q_id", "f.*")
    rows = files.select(F.col("_q_id").alias(id), "tongue", F.posexplode(F.split("t", " ")).alias("pos", "t"))
    return rows.select(id, "tongue", "pos", F.substring_index("t", ",", 1).alias("kind"), F.substring_index("t", ",", -1).cast("int").alias("line"))


def pairs(spark) -> DataFrame:
    """The permitted pairs of all languages: a fixed table of some thousand rows."""
    rows = [(g, a, b) for g in grammar.LANGUAGES for a, b in sorted(grammar.permitted(g))]
    return spark.createDataFrame(rows, "tongue string, kind string, next string")


def faults(df: DataFrame, id: str = "file_id", path: str = "file_path", source: str = "source") -> DataFrame:
    """(id, tongue, pair_line, nesting_line, production_line): files with a fault, and its first line by kind."""
    order = Window.partitionBy(id).orderBy("pos")
    opens, closes = F.col("kind").isin(*_BRACKETS), F.col("kind").isin(*_BRACKETS.values())
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    shift = F.when(F.col("kind") == "INDENT", 1).when(F.col("kind") == "DEDENT", -1).otherwise(0)
    rows = tokens(df, id, path, source)
    rows = rows.select(
        "*", F.lead("kind").over(order).alias("next"), F.lag("kind").over(order).alias("before"), F.lead("kind", 2).over(order).alias("next2"), F.lead("kind", 3).over(order).alias("next3"),
        F.sum(step).over(order).alias("after"), F.sum(shift).over(order).alias("indent"),
        F.sum(F.when(F.col("kind").isin("NL", "CNL", "DEDENT"), 1).otherwise(0)).over(order).alias("statement"),
    )
    # anti-join: the adjacent pairs that have no partner among the permitted ones
    known = F.broadcast(pairs(df.sparkSession).withColumn("permitted", F.lit(True)))
    rows = rows.join(known, ["tongue", "kind", "next"], "left").withColumn("level", F.col("after") + F.when(closes, 1).otherwise(0))
    alien = F.col("next").isNotNull() & F.col("permitted").isNull()
    # nesting: a closing bracket meets, as the last bracket of its level, one that opens and fits it
    last = F.lag(F.when(opens | closes, F.col("kind")), 1).over(Window.partitionBy(id, "level", opens | closes).orderBy("pos"))
    fits = F.try_element_at(F.create_map(*[F.lit(x) for o, c in _BRACKETS.items() for x in (c, o)]), F.col("kind"))
    torn = closes & ((F.col("level") < 1) | (F.coalesce(last, F.lit("")) != fits)) | (F.col("kind") == "EOF") & (F.col("after") != 0)
    # productions: heads end in a colon, try has a handler, declarations at the top, no object as a statement
    python = F.col("tongue") == "python"
    line = Window.partitionBy(id, "statement")
    begins = F.col("before").isin("BOF", "NL", "INDENT", "DEDENT") | F.col("before").isNull()
    colon = F.max(F.when((F.col("kind") == "COLON") & (F.col("after") == 0), 1).otherwise(0)).over(line)
    headless = python & begins & F.col("kind").isin("C", "Z", "T", "H") & (colon == 0)
    handler = F.lead("kind").over(Window.partitionBy(id, "indent", python & begins & ~F.col("kind").isin("INDENT", "DEDENT")).orderBy("pos"))
    bare = python & begins & (F.col("kind") == "T") & (F.coalesce(handler, F.lit("")) != "H")
    top = (F.col("before").isin("BOF", "SEMI") | (F.col("before") == "RC")) & (F.coalesce(F.col("after") - step, F.lit(0)) == 0)
    lost = F.lit(False)
    for tongue, kinds in TOP.items():
        lost = lost | ((F.col("tongue") == tongue) & ~F.col("kind").isin(*kinds))
    lost = lost | ((F.col("tongue") == "rust") & (F.col("kind") == "N") & ~F.col("next").isin("U", "COLON"))
    record = F.col("tongue").isin("javascript", "typescript") & (F.col("kind") == "BOF") & (F.col("next") == "LC") & (F.col("next2") == "L") & (F.col("next3") == "COLON")
    flags = rows.select(id, "tongue", "line", alien.alias("alien"), torn.alias("torn"), (headless | bare | (top & lost) | record).alias("unproduced"))
    first = lambda c: F.min(F.when(F.col(c), F.col("line")))
    found = flags.groupBy(id, "tongue").agg(first("alien").alias("pair_line"), first("torn").alias("nesting_line"), first("unproduced").alias("production_line"))
    return found.where(F.coalesce("pair_line", "nesting_line", "production_line").isNotNull())


def rates(df: DataFrame, id: str = "file_id", path: str = "file_path", source: str = "source", repo: str = "repo_url", language: str = "language") -> DataFrame:
    """Per repository and language the number of files, of invalid ones, and their rate."""
    files = df.groupBy(F.col(id).alias(id)).agg(F.min(repo).alias("repo_url"), F.min(language).alias("language"))
    bad = faults(df, id, path, source).select(id, F.lit(1).alias("bad"))
    joined = files.join(bad, id, "left").groupBy("repo_url", "language").agg(F.count("*").alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"))
    return joined.withColumn("rate", F.col("invalid") / F.col("files"))

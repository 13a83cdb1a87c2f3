"""Encoding a corpus with a public byte-level BPE by a shuffle of its distinct words.

Texts are split into pre-tokens in the JVM, every distinct pre-token is encoded once, and the
ids return to their documents by a join and are put in order by position.

Defined results: null and empty texts give an empty list; text that looks like a special token
is plain text; equal texts under several ids each get a row.  ``id`` is taken as unique.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.session import cut

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("QUARRYKIT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split of text before merges, part of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most frequent words whose ids are broadcast, and their greatest length: a bound of some megabytes.
HOT, HOT_LENGTH = 50_000, 32
#: Rows of a word that share one salt in the join of all other words.
SALTED = 1_000_000
_S = "_q_"


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    # a pre-token comes already split: the pattern takes it whole
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})


def pretokens(df: DataFrame, id: str, text: str) -> DataFrame:
    """(document, position, word) rows of all texts."""
    words = F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))
    return df.where(F.length(text) > 0).select(F.col(id).alias(_S + "doc"), F.posexplode(words).alias(_S + "pos", _S + "word"))


def dictionary(df: DataFrame, id: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each distinct word with its ids and the number of its occurrences; cut by a checkpoint."""
    path = os.path.join(tokenizers, vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for b in batches:
            yield b.assign(**{_S + "ids": [encoder.encode_ordinary(w) for w in b[_S + "word"]]})

    counts = pretokens(df, id, text).groupBy(_S + "word").agg(F.count("*").alias(_S + "n"))
    return cut(counts.mapInPandas(encode, f"{_S}word string, {_S}n bigint, {_S}ids array<int>"))


def _uses(df: DataFrame, id: str, text: str, words: DataFrame, value: str) -> DataFrame:
    """(document, position, value): every occurrence of a word with a column of the dictionary.

    Most occurrences are of few words: those find their value in a broadcast table of bounded size and
    do not move.  The others are joined with the dictionary by word, long frequent ones salted.
    """
    top = words.where(F.length(_S + "word") <= HOT_LENGTH).orderBy(F.desc(_S + "n"), _S + "word").limit(HOT)
    # proven bound: HOT words of at most HOT_LENGTH characters
    hot = F.broadcast(top.select(_S + "word", F.col(value).alias(_S + "hot")))
    uses = pretokens(df, id, text).join(hot, _S + "word", "left")
    rows = uses.where(F.col(_S + "hot").isNotNull()).select(_S + "doc", _S + "pos", F.col(_S + "hot").alias(value))
    salts = F.ceil(F.col(_S + "n") / SALTED).cast("int")
    rest = words.join(hot, _S + "word", "left_anti").select(_S + "word", value, salts.alias(_S + "salts"))
    copies = rest.select(_S + "word", value, F.explode(F.sequence(F.lit(0), F.col(_S + "salts") - 1)).alias(_S + "salt"))
    # words with several salts: their number is bounded by all rows over SALTED
    many = F.broadcast(rest.where(F.col(_S + "salts") > 1).select(_S + "word", _S + "salts"))
    cold = uses.where(F.col(_S + "hot").isNull()).join(many, _S + "word", "left")
    cold = cold.withColumn(_S + "salt", F.expr(f"cast(pmod(xxhash64({_S}doc), coalesce({_S}salts, 1)) as int)"))
    return rows.unionByName(cold.join(copies, [_S + "word", _S + "salt"]).select(_S + "doc", _S + "pos", value))


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every document."""
    words = dictionary(df, id, text, tokenizers, vocabulary)
    rows = _uses(df, id, text, words, _S + "ids")
    # a task holds whole documents, so their rows are put together before the shuffle
    placed = rows.groupBy(_S + "doc").agg(F.array_sort(F.collect_list(F.struct(F.col(_S + "pos").alias("p"), F.col(_S + "ids").alias("ids")))).alias(_S + "all"))
    full = placed.select(F.col(_S + "doc").alias(id), F.flatten(F.transform(_S + "all", lambda w: w["ids"])).alias("ids"))
    blank = df.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(id, F.array().cast("array<int>").alias("ids"))
    return full.unionByName(blank)


def sizes(df: DataFrame, id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the number of token ids of every document that has any; sums of the words' sizes, no lists."""
    words = dictionary(df, id, text, tokenizers, vocabulary).withColumn(_S + "size", F.size(_S + "ids").cast("bigint"))
    rows = _uses(df, id, text, words, _S + "size")
    return rows.groupBy(F.col(_S + "doc").alias(id)).agg(F.sum(_S + "size").alias("tokens"))


def token_bytes(spark, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The table of the vocabulary: token id and its bytes in hexadecimal (50,256 rows)."""
    lines = spark.read.text(os.path.join(tokenizers, vocabulary)).select(F.split("value", " ").alias("s"))
    return lines.select(F.col("s")[1].cast("int").alias("token"), F.hex(F.unbase64(F.col("s")[0])).alias("hex"))


def decode(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): texts from token ids by a join with the vocabulary's table; an empty list gives ''."""
    table = F.broadcast(token_bytes(encoded.sparkSession, tokenizers, vocabulary))  # fixed size of the vocabulary
    rows = encoded.select(F.col(id).alias(_S + "doc"), F.posexplode_outer(ids).alias(_S + "pos", "token")).join(table, "token", "left")
    parts = rows.groupBy(_S + "doc").agg(F.array_sort(F.collect_list(F.struct(_S + "pos", F.coalesce("hex", F.lit("")).alias("hex")))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "UTF-8")
    return parts.select(F.col(_S + "doc").alias(id), text.alias("text"))

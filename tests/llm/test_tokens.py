from __future__ import annotations

import pytest

from quarrykit.llm import tokens

TEXTS = [
    None, "", " ", "Hello, world!  \n\n\tx", "<|endoftext|> is text", "naïve façade coöperate 🚀✨ \u200b\ufeff", "don't we'll I'VE", "a" * 3000, "1234 ½ ٣ Ⅷ", "\r\nx\r\r y\u00a0\u2003z \u0085 \u2028 end ",
    "Hello, world!  \n\n\tx", "日本語のテキスト and ไทย", "\x00\x01\x1c\x1d", "  lead", "trail   ", "the the the the", "x" + " " * 50 + "y",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


@pytest.mark.parametrize("hot,salted", [(50_000, 1_000_000), (3, 2), (1, 1)])
def test_same_ids_as_the_library(spark, monkeypatch, hot, salted):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "HOT", hot)
    monkeypatch.setattr(tokens, "SALTED", salted)
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokens.encode(frame(spark)).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_round_trip(spark):
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(frame(spark))).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}

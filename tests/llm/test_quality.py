from __future__ import annotations

from quarrykit.llm import quality

PROSE = "It is slower than it looks, because the order of the entries has to be kept. When a file has no owner, the worker falls back to the copy in memory."
TEXTS = [
    (PROSE, False), (PROSE.replace(" ", "\n", 8), False), ("> " + PROSE + "\n\n" + PROSE, False), (PROSE.lower().replace(".", "").replace(",", ""), False), ("  " + PROSE, False), (None, False), ("", False), (" \n\t", False),
    ("\n".join(f"- {PROSE}" for _ in range(3)), True), ("\n".join(f"{i}. `fix_{i}` (local)" for i in range(9)), True), ("| a | b |\n|---|---|\n" + "| x | 1 |\n" * 20, True), ("a,count,share\n" + "chunk_digest,67079,21.17\n" * 9, True),
    ("def f(x):\n    # " + PROSE + "\n    return x\n\nimport os\nfrom a import b\n" * 3, True), ("2024-08-03T21:40:07Z DEBUG [label-7] retrying the stage id=eq\n" * 6, True), ("arKowLe9JXSl0pUhyI/eZpCoHUL2nS5Y" * 30, True), ("=-" * 200, True),
    ("Sign in\nHistory\nDocs\nEdit\nHome\nNext\nToken\nRoute\nBlame", True), ("tool; policy; commit-tool; broken; frozen free; channel; queue; index; mixed free", True), (PROSE + "\n\n- item\n- item", False),
]


def test_prose_and_all_else(spark):
    words = spark.createDataFrame([("en", w) for w in "it is than because the of has to be when a no in and for that with are on".split()], "lang string, word string")
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, 1) for i, (t, _) in enumerate(TEXTS)], "doc_id int, text string, lang string, words int")
    rows = {r.doc_id: r for r in quality.scored(df, words).collect()}
    assert {i: rows[i].no_prose for i in rows} == {i: x for i, (_, x) in enumerate(TEXTS)}
    assert rows[0].words == len(PROSE.split()) and rows[6].words == 0 and rows[6].mean_word_length is None and 0 <= rows[0].p_symbol_ratio <= 100


def test_the_cut_comes_from_the_sketch_of_each_language(spark):
    from pyspark.sql import functions as F

    rows = [("a", 0.30 + i / 400) for i in range(60)] + [("a", 0.95 + i / 1000) for i in range(40)]  # two parts: the cut lies between them, not at a half
    rows += [("b", i / 1000) for i in range(100)]  # prose only
    rows += [("c", 1 - i / 1000) for i in range(80)] + [("c", i / 1000) for i in range(20)]  # the greater part is no prose
    df = spark.createDataFrame(rows, "g string, v double").select("g", *[F.col("v").alias(s) for s in quality.STATISTICS])
    cut = {r.g: r for r in quality.cuts(df.groupBy("g").agg(*[F.kll_sketch_agg_double(s).alias(s) for s in quality.STATISTICS]), "g").collect()}
    assert 0.65 < cut["a"].c_loose_share < 0.75 and abs(cut["a"].m_loose_share - 0.375) < 0.01
    assert cut["b"].c_loose_share == 0.5 and 0.03 < cut["b"].m_symbol_ratio < 0.07 and cut["b"].c_symbol_ratio > 0.1
    assert 0.4 < cut["c"].c_loose_share < 0.6 and cut["c"].m_loose_share > 0.9

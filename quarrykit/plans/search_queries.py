"""Retrieval: term statistics, BM25, vectors, fusion, filters after the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import search
from quarrykit.plans import Registry
from quarrykit.session import table

registry = Registry()
query = registry.query

#: Search texts of the registered queries.
TEXTS = {"q1": "how does the search index read the parser output", "q2": "report archive cache cache", "q3": "merge_segment", "q4": "agent memory shared queue"}
_TERMS = "list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_ASKED = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TEXTS.items()) + ") t(query_id, query))"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS.items()), "query_id string, query string")


def bm25_sql(docs: str, id: str, text: str, asked: str, k: int) -> str:
    return f"""
WITH d AS (SELECT {id} AS id, {_TERMS.format(t=text)} AS t FROM {docs}), s AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM d),
p AS (SELECT id, len(t) AS doc_len, unnest(t) AS term FROM d), h AS (SELECT id, doc_len, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term), a0 AS (SELECT query_id, unnest({_TERMS.format(t='query')}) AS term FROM {asked}), a AS (SELECT query_id, term, count(*) AS qtf FROM a0 GROUP BY ALL),
x AS (SELECT query_id, id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl))), 4) AS score FROM h JOIN f USING (term) JOIN a USING (term), s GROUP BY ALL)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM x WHERE score > 0) WHERE rank <= {k}"""


CHUNKS = "(SELECT id, any_value(content) AS content, any_value(file_path) AS file_path, any_value(chunk_type) AS chunk_type, any_value(language) AS language, any_value(start_line) AS start_line, any_value(collection) AS collection FROM code_chunks GROUP BY id)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each id once; what differs between repeated rows is the time only."""
    return table(spark, d, "code_chunks").select("id", "content", "file_path", "chunk_type", "language", "start_line", "collection").dropDuplicates(["id"])


@query("term_statistics", f"""
WITH p AS (SELECT doc_id, unnest({_TERMS.format(t='text')}) AS term FROM documents), h AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM h GROUP BY term""")
def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("corpus_term_stats", f"SELECT count(*) AS documents, round(avg(coalesce(len({_TERMS.format(t='text')}), 0)), 6) AS mean_length FROM documents")
def corpus_term_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size(T.terms(F.col("text"))), F.lit(0))
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.round(F.avg(n), 6).alias("mean_length"))


@query("bm25_search", bm25_sql("documents", "doc_id", "text", _ASKED, 10))
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), asked(spark), "doc_id", "text", "query_id", "query", 10)


_BATCH = "(SELECT doc_id AS query_id, split_part(text, '.', 1) AS query FROM documents WHERE doc_id % 50 = 0)"


@query("bm25_batch", bm25_sql("documents", "doc_id", "text", _BATCH, 5))
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 50 asks, with its first sentence, all documents."""
    docs = table(spark, d, "documents")
    batch = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("query"))
    return search.bm25_batch(docs, batch, "doc_id", "text", "query_id", "query", 5)


_COS = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / nullif(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 0), 6)"


@query("vector_top", f"""
WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS.format(a='v.embedding', b='q.embedding')} AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank FROM p) WHERE rank <= 10""")
def vector_top(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.vector_top(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q").withColumnRenamed("embedding", "qv"), "vec_id", "embedding", "q", "qv", 10)


@query("vector_top_filtered", f"""
WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, {_COS.format(a='v.embedding', b='q.embedding')} AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, id, label, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) WHERE rank <= 20 AND label = 3""")
def vector_top_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter holds after the ranking: it does not let further rows into the top."""
    rows = table(spark, d, "embeddings")
    top = search.vector_top(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q").withColumnRenamed("embedding", "qv"), "vec_id", "embedding", "q", "qv", 20)
    return top.join(rows.select(F.col("vec_id").alias("id"), "label"), "id").where("label = 3").select("query_id", "id", "label", "similarity")


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = chunks(spark, d)
    words = search.bm25(rows, asked(spark), "id", "content", "query_id", "query", 16)
    code = search.bm25(rows.where("chunk_type = 'function'"), asked(spark), "id", "content", "query_id", "query", 16)
    return words, code


_FUSED = f"""
WITH a AS ({bm25_sql(CHUNKS, 'id', 'content', _ASKED, 16)}), b AS ({bm25_sql("(SELECT * FROM " + CHUNKS + " WHERE chunk_type = 'function')", 'id', 'content', _ASKED, 16)}),
u AS (SELECT query_id, id, 0.6 / (60 + rank) AS s, 'all' AS source FROM a UNION ALL SELECT query_id, id, 0.4 / (60 + rank), 'functions' FROM b),
k AS (SELECT u.query_id, c.file_path || ':' || c.start_line AS place, u.s, u.source FROM u JOIN {CHUNKS} c USING (id)),
g AS (SELECT query_id, place, round(sum(s), 6) AS score, list_sort(list(DISTINCT source)) AS sources FROM k GROUP BY ALL)
SELECT query_id, place, score, sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place)::INTEGER AS rank FROM g) WHERE rank <= 8"""


@query("rank_fusion", _FUSED)
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists fused on the place of a chunk; chunks of one place collide and add up."""
    rows = chunks(spark, d).select("id", F.concat_ws(":", "file_path", F.col("start_line").cast("string")).alias("place"))
    words, code = (x.join(rows, "id") for x in _two_lists(spark, d))
    return search.fused({"all": words, "functions": code}, {"all": 0.6, "functions": 0.4}, ["place"], 8)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their latest vector, each id once."""
    rows = table(spark, d, "code_chunks").where("embedding is not null and id is not null")
    return rows.groupBy("id").agg(F.max_by(F.struct("embedding", "content", "chunk_type", "file_path", "start_line"), F.struct("created_at", F.size("embedding"))).alias("c")).select("id", "c.*")


def _hybrid(spark: SparkSession, d: str, n: int, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every question with the vector of the chunk that answers it best by keywords, against all chunks."""
    rows = _vectors(spark, d)
    kinds = rows.select("id", "chunk_type")
    words = search.bm25(rows, asked(spark), "id", "content", "query_id", "query", 2 * n)
    meant = words.where("rank = 1").join(rows.select("id", "embedding"), "id").select(F.col("query_id").alias("q"), F.col("embedding").alias("qv"))
    near = search.vector_top(rows, meant, "id", "embedding", "q", "qv", 2 * n).withColumnsRenamed({"q": "query_id"})
    keep = None if kind is None else F.col("chunk_type") == kind
    lists = [x.select("query_id", "id", "rank").join(kinds, "id") for x in (words, near)]
    return search.hybrid(*lists, asked(spark), ["id"], n, keep), rows


@query("hybrid_search")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector candidates of chunks fused, functions first."""
    both, rows = _hybrid(spark, d, 8)
    return search.by_kind(both.join(rows.select("id", "chunk_type", "file_path", "start_line"), "id"))


@query("hybrid_search_functions")
def hybrid_search_functions(spark: SparkSession, d: str) -> DataFrame:
    """The same for functions only; the filter holds after both rankings."""
    return _hybrid(spark, d, 8, "function")[0]


@query("search_code")
def search_code(spark: SparkSession, d: str) -> DataFrame:
    """The best four chunks of every question with the first 500 characters of each, the length of a snippet."""
    both, rows = _hybrid(spark, d, 4)
    return both.join(rows.select("id", "file_path", F.substring("content", 1, 500).alias("snippet")), "id").select("query_id", "rank", "id", "file_path", "score", "snippet")


@query("answer_context", f"""
WITH a AS ({bm25_sql(CHUNKS, 'id', 'content', _ASKED, 8)}), k AS (SELECT a.*, c.chunk_type, c.file_path, c.content FROM a JOIN {CHUNKS} c USING (id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE chunk_type WHEN 'function' THEN 0 WHEN 'class' THEN 1 ELSE 2 END, rank) AS position FROM k)
SELECT query_id, string_agg('[' || file_path || ']' || chr(10) || substr(content, 1, 500), chr(10) || chr(10) ORDER BY position) AS context, count(*) AS chunks FROM o GROUP BY query_id""")
def answer_context(spark: SparkSession, d: str) -> DataFrame:
    """The best eight chunks of each question as one text, functions first."""
    rows = chunks(spark, d)
    top = search.by_kind(search.bm25(rows, asked(spark), "id", "content", "query_id", "query", 8).join(rows.select("id", "chunk_type", "file_path", "content"), "id"))
    piece = F.concat(F.lit("["), F.col("file_path"), F.lit("]\n"), F.substring("content", 1, 500))
    parts = F.array_sort(F.collect_list(F.struct("position", piece.alias("piece"))))
    return top.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "\n\n").alias("context"), F.count("*").alias("chunks"))


@query("query_kinds", f"""
WITH q AS (SELECT name AS query FROM (SELECT DISTINCT name FROM code_functions) UNION SELECT split_part(text, '.', 1) FROM documents WHERE text IS NOT NULL)
SELECT query, (NOT ({" OR ".join(f"starts_with(lower(query), '{w}') OR contains(' ' || lower(query) || ' ', ' {w} ')" for w in T.QUESTION_WORDS)}))
 AND (regexp_matches(query, '[A-Z]{{2}}|_[a-z]|[a-z][A-Z]|\\.\\w+\\(|::') OR len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '')) <= 3) AS is_keyword FROM q""")
def query_kinds(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "code_functions").select(F.col("name").alias("query"))
    heads = table(spark, d, "documents").where("text is not null").select(F.split_part("text", F.lit("."), F.lit(1)).alias("query"))
    return names.union(heads).distinct().select("query", T.is_keyword_query(F.col("query")).alias("is_keyword"))

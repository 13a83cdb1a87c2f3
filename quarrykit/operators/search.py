"""Keyword, vector and fused retrieval."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.session import parts, ship, written


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, term, tf, doc_len): term frequencies; documents without terms have no row."""
    terms = docs.select(F.col(id).alias("id"), T.terms(F.col(text)).alias("t"))
    rows = terms.select("id", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    return rows.groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, id: str, text: str, query_id: str, query: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` documents of every query.

    Queries are joined with the postings of their terms, so that only matching documents are
    touched; a term that stands twice in a query counts twice.  Scores above zero only, rounded
    to four places, ties by id.  The number of documents includes those without terms.  Every pair of
    a query and a document that share a term is shuffled: ``bm25_batch`` is for more than a few queries.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(T.terms(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = docs.select(F.col(id).alias("id"), T.terms(F.col(text)).alias("t"))
    size = terms.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size("t"), F.lit(0))).alias("avgdl"))
    wanted = asked.select("term").distinct()
    hits = terms.select("id", F.size("t").alias("doc_len"), F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").join(asked, "term").join(F.broadcast(size), F.lit(True))  # size is one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    sums = scored.groupBy("query_id", "id").agg(F.round(F.sum(part * F.col("qtf")), 4).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)


#: Documents that are scored at once, or as many as have so many bytes of terms; queries that are read at once.
DOCS, BYTES, ASKED = 65536, 1 << 26, 16384


def _table(files: list[str]) -> pa.Table:
    from pyarrow import fs, parquet

    def one(file: str) -> pa.Table:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            return parquet.ParquetFile(f).read()

    return pa.concat_tables([one(f) for f in files])


def _entries(rows: pa.Array, terms: int) -> tuple[np.ndarray, ...]:
    """(doc, doc_len) of every document, and (document, term, tf) of every pair by term; rows of one id and length are one document."""
    inner = rows.flatten()
    n, lists = pc.struct_field(inner, 0).to_numpy(zero_copy_only=False), pc.struct_field(inner, 1)
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
    known, place = np.unique(doc << 32 | n, return_inverse=True)
    of = np.repeat(place, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    key, tf = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(known)) + of, return_counts=True)
    term, at = np.divmod(key, max(1, len(known)))
    return known >> 32, known & 0xFFFFFFFF, at, term, tf


def _best(ask: Iterable[tuple[list[tuple[int, float, float]], float]], docs: np.ndarray, weight: np.ndarray, size: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, scores) for each query: its best ``k`` of a block, without those that are certainly below its bar.

    A query is its terms as (first entry, entry behind the last, times, most that it adds), the dearest first.  Terms are added up
    for all documents as long as one without the terms so far could still be among the best; the rest only for those that can.
    """
    slack = 1e-4  # of rounding to four places
    score = np.zeros(size)
    for terms, bar in ask:
        rest = [0.0]
        for t in reversed(terms):
            rest.append(rest[-1] + t[3])
        rest.reverse()
        need, i = bar - slack, 0
        while i < len(terms) and rest[i] >= need:
            a, b, times, _ = terms[i]
            here = docs[a:b]
            now = score[here] + (weight[a:b] if times == 1 else weight[a:b] * times)
            score[here] = now
            i += 1
            if i < len(terms) and k <= b - a and need < rest[0]:
                need = max(need, np.partition(now, b - a - k)[b - a - k] - slack)  # a part of a score is no more than the score
        found = np.flatnonzero(score >= need - rest[i]) if need > rest[i] else np.flatnonzero(score)
        sums = score[found]
        for j in range(i, len(terms)):
            if len(found) > k:
                need = max(need, np.partition(sums, len(sums) - k)[len(sums) - k] - slack)
            can = sums >= need - rest[j]
            found, sums = found[can], sums[can]
            a, b, times, _ = terms[j]
            here = docs[a:b]
            if b - a < 10 * len(found):  # cheaper than to look each one up
                score[found] = sums
                score[here] += weight[a:b] * times
                sums = score[found]
            else:
                at = np.minimum(np.searchsorted(here, found), b - a - 1)
                sums = sums + np.where(here[at] == found, weight[a:b][at] * times, 0.0)
        score.fill(0)
        sums = np.floor(sums * 1e4 + 0.5) / 1e4
        can = (sums > 0) & (sums >= bar)
        if np.count_nonzero(can) > k:
            can &= sums >= np.partition(sums, len(sums) - k)[len(sums) - k]
        found, sums = found[can], sums[can]
        first = np.lexsort((found, -sums))[:k]
        yield found[first], sums[first]


def bm25_batch(docs: DataFrame, queries: DataFrame, id: str, text: str, query_id: str, query: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The rows of ``bm25``, for a batch of queries that grows with the documents.

    The pairs of queries and documents that share a term are then too many to be moved.  Documents go into the shared folder
    as numbers of the terms that are asked for, one row per id; every task scores a block of them against all queries in
    memory, and only the best ``k`` of each task and query are shuffled.  Ties by id, null last.
    """
    spark = docs.sparkSession
    ship(spark)
    pairs = queries.select(F.col(query_id).alias("query_id"), F.explode(T.terms(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = written(pairs.groupBy("query_id").agg(F.collect_list(F.struct("term", "qtf")).alias("terms")))
    words = written(asked.select(F.explode("terms.term").alias("term")).distinct())
    asked_files, word_files = sorted(asked.inputFiles()), sorted(words.inputFiles())
    rows = docs.select(F.col(id).alias("id"), T.terms(F.col(text)).alias("t"))
    kinds = {"id": dict(rows.dtypes)["id"], "query_id": dict(asked.dtypes)["query_id"]}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(word_files).column("term").combine_chunks()
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            number = pc.index_in(batch.column(1).flatten(), value_set=known)
            there = pc.is_valid(number).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(n)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), number.drop_null())], ["id", "n", "terms"])

    numbers = rows.mapInArrow(numbered, f"id {kinds['id']}, n int, terms array<int>").repartition(parts(spark), "id")
    by_id = written(numbers.groupBy("id").agg(F.collect_list(F.struct("n", "terms")).alias("rows")))
    n, mean = by_id.select(F.explode("rows.n").alias("n")).agg(F.count("*"), F.avg("n")).first()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(_table(word_files)), dtype=np.int64)
        for batch in batches:
            df += np.bincount(_entries(batch.column(1), len(df))[3], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["term", "df"])

    df_files = sorted(written(by_id.mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))).inputFiles())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= DOCS or sum(x.nbytes for x in held) >= BYTES:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _table(word_files).column("term").combine_chunks(), _table(df_files)
        df = np.zeros(len(known))
        df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        every = []
        for part in _table(asked_files).to_batches(ASKED):
            terms = part.column("terms")
            inner = terms.flatten()
            every.append([part.column("query_id"), np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())]), pc.index_in(pc.struct_field(inner, 0), value_set=known).to_numpy(), pc.struct_field(inner, 1).to_numpy().astype(float), np.zeros(len(part)), None])
        for block in blocks(batches):
            block = block.take(pc.sort_indices(block.column("id")))
            doc, size, at, term, tf = _entries(block.column("rows").combine_chunks(), len(known))
            weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[at] / mean))
            key = term * len(block) + doc[at]
            first = np.flatnonzero(np.diff(key, prepend=-1))  # documents of one id are added up
            if len(first) < len(key):
                weight = np.add.reduceat(weight, first)
            term, docs_of = key[first] // len(block), key[first] % len(block)
            starts = np.searchsorted(term, np.arange(len(known) + 1))
            most = np.zeros(len(known))
            if len(term):
                most[term[np.flatnonzero(np.diff(term, prepend=-1))]] = np.maximum.reduceat(weight, np.flatnonzero(np.diff(term, prepend=-1)))
            for q in every:
                query_ids, ends, number, times, bars, best = q
                adds = most[number] * times
                order = np.lexsort((-adds, np.repeat(np.arange(len(bars)), np.diff(ends))))
                lists = list(zip(starts[number[order]].tolist(), starts[number[order] + 1].tolist(), times[order].tolist(), adds[order].tolist(), strict=True))
                ask = (([t for t in lists[ends[i] : ends[i + 1]] if t[3] > 0], bars[i]) for i in range(len(bars)))
                found = list(_best(ask, docs_of, weight, len(block), k))
                new = pa.table({"q": np.repeat(np.arange(len(bars)), [len(x) for x, _ in found]), "score": np.concatenate([s for _, s in found]), "id": block.column("id").take(pa.array(np.concatenate([x for x, _ in found])))})
                best = (new if best is None else pa.concat_tables([best, new])).sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
                asking = best.column("q").to_numpy()
                place = np.arange(len(asking)) - np.searchsorted(asking, asking)
                best = best.filter(pa.array(place < k))
                last = place == k - 1
                bars[asking[last]] = best.column("score").to_numpy()[np.flatnonzero(last[place < k])]
                q[5] = best
        for query_ids, *_, best in every:
            if best is not None:
                yield from best.select(["id", "score"]).add_column(0, "query_id", query_ids.take(best.column("q").combine_chunks())).to_batches()

    found = by_id.mapInArrow(search, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision; null if either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Queries that are compared at once with a batch of vectors.
BLOCK = 1024


def vector_top(vectors: DataFrame, queries: DataFrame, id: str, vector: str, query_id: str, query_vector: str, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): exact nearest vectors of a stated set of queries.

    The queries are written to the shared folder and read in blocks by every task, so their number is not
    bounded by a broadcast; a block meets a batch of vectors in one matrix product, and the best ``k`` of
    the batch go on.  Null vectors, vectors with nulls, and vectors of another length than the query's
    do not take part, nor do those that are all zero; similarities have six places, ties go by id.
    """
    whole = lambda df, c: df.where(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()))
    asked = written(whole(queries, query_vector).where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")))
    rows = whole(vectors, vector).where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    files = sorted(asked.inputFiles())
    kinds = {"id": dict(rows.dtypes)["id"], "query_id": dict(asked.dtypes)["query_id"]}

    def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and unit vectors, for each length that occurs."""
        lengths = np.diff(column.offsets.to_numpy())
        flat, starts = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            m = flat[starts[at][:, None] + np.arange(n)]
            with np.errstate(all="ignore"):
                norm = np.sqrt((m * m).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            yield at[good], m[good] / norm[good][:, None]

    def blocks() -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        for file in files:
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_file(path) as f:
                yield from parquet.ParquetFile(f).iter_batches(BLOCK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(np.argsort(np.array(b.column(0).to_pylist(), dtype=object), kind="stable"))  # place of each id
            mine = {m.shape[1]: (at, m) for at, m in by_length(b.column(1)) if len(at)}
            for block in blocks():
                for qat, q in by_length(block.column(1)):
                    if not len(qat) or q.shape[1] not in mine:
                        continue
                    at, m = mine[q.shape[1]]
                    score = np.round(q @ m.T, 6)
                    n = min(k, score.shape[1])
                    bar = -np.partition(-score, n - 1, axis=1)[:, n - 1]
                    row, col = np.nonzero(score >= bar[:, None])
                    best = np.lexsort((order[at[col]], -score[row, col], row))
                    row, col = row[best], col[best]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < k  # of equal ones the smaller ids
                    row, col = row[first], col[first]
                    yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(qat[row])), b.column(0).take(pa.array(at[col])), pa.array(score[row, col])], ["query_id", "id", "similarity"])

    pairs = rows.mapInArrow(search, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def fused(lists: Mapping[str, DataFrame], weights: Mapping[str, float], key: Iterable[str], n: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: (query_id, key..., score, sources, rank) of ranked lists.

    Each list has ``query_id``, the key columns and ``rank`` from 1.  A key that stands twice in a
    list adds twice.  One union and one aggregate, no outer join.
    """
    key = list(key)
    parts = None
    for name, rows in lists.items():
        part = rows.select("query_id", *key, (F.lit(weights[name]) / (k + F.col("rank"))).alias("s"), F.lit(name).alias("source"))
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("query_id", *key).agg(F.round(F.sum("s"), 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *key))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def hybrid(words: DataFrame, near: DataFrame, queries: DataFrame, key: Iterable[str], n: int, keep: Column | None = None) -> DataFrame:
    """(query_id, key..., score, sources, rank): keyword and vector candidates fused, 2n of each.

    Queries that look like identifiers lean on keywords (0.7 to 0.3), others on vectors (0.6 to 0.4).
    ``keep``, a condition on the candidates' columns, holds after their ranking: it lets no further
    candidates in.  A query for which nothing is left gives no row.
    """
    key = list(key)
    leans = queries.select("query_id", T.is_keyword_query(F.col("query")).alias("_q_k"))
    parts = None
    for name, rows, plain, code in (("bm25", words, 0.4, 0.7), ("vector", near, 0.6, 0.3)):
        part = rows.where(F.col("rank") <= 2 * n)
        part = (part if keep is None else part.where(keep)).join(leans, "query_id")
        part = part.select("query_id", *key, (F.when(F.col("_q_k"), code).otherwise(plain) / (60 + F.col("rank"))).alias("s"), F.lit(name).alias("source"))
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("query_id", *key).agg(F.round(F.sum("s"), 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *key))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def by_kind(results: DataFrame, kind: str = "chunk_type") -> DataFrame:
    """Results in the order in which a reader wants them: functions, classes, the rest, each by rank."""
    order = F.when(F.col(kind) == "function", 0).when(F.col(kind) == "class", 1).otherwise(2)
    return results.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "rank")))

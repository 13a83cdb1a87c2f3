"""Most similar vectors of every vector, by shifted Hilbert curves.

Each vector is projected to a few dimensions, once per curve with other directions and another
shift, and gets its place on a Hilbert curve there.  Spark range-partitions and sorts the rows of
all curves; neighbouring windows of the order are compared by short codes in matrix products,
the candidates of all curves merge, and full vectors rerank them.

Defined results: only vectors of ``width`` finite numbers that are not all zero take part; an id
counts once, by its latest row; equal vectors are neighbours with similarity 1; ties in the
rank go to the smaller id.  Equal vectors are folded first: only one of them is searched for,
and its copies are added to what was found.  Accuracy is measured against brute force in the
tests and by :func:`recall`.  Where no least similarity bounds the search, all members of a cluster
are about equally near: :func:`nearest` has curves in a fitted subspace and wider windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.session import spread, written

CURVES, DIMENSIONS, BITS = 12, 12, 5  # a key has DIMENSIONS * BITS = 60 bits
CODE = 96  # dimensions of the short codes
WINDOW, BLOCK = 64, 256
#: How far a code's similarity may lie below the wanted one; over three standard deviations of its error.
MARGIN = 0.06
SEED = 11
#: Curves of the search without a least similarity: their number, the fitted subspace, dimensions and bits of a key,
#: and the greatest number of vectors on which the subspace is fitted.
TURNS, SPACE, TURNED, FINE, FIT = 5, 32, 20, 3, 20_000
#: Rows before and behind a row that it is compared with, rows taken at once, and windows in a task's stretch.
REACH, STEP, STRETCH = 2560, 1024, 16
#: Queries of the exact search in a block, and vectors in a tile of all.
ROWS, TILE = 1024, 1024


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, m), m * bits < 63, by Skilling's transform (2004)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    m, bit = len(x), 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(m):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, m):
        x[i] = x[i] ^ x[i - 1]
    flips, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flips ^= np.where((x[m - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | (((x[i] ^ flips) >> b) & 1)
    return key


@lru_cache(maxsize=2)
def _directions(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions and the shift of each curve, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(rng.standard_normal((width, width)))[0].astype(np.float32)
    return q, rng.uniform(-0.08, 0.08, (CURVES, DIMENSIONS)).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    data = np.ascontiguousarray(rows)
    step = data.shape[1] * data.itemsize
    ends = pa.py_buffer(np.arange(0, (len(data) + 1) * step, step, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, ends, pa.py_buffer(data)])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column without nulls, of equal lengths, as a matrix."""
    parts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(parts)
    ends = np.frombuffer(parts.buffers()[1], dtype=np.int32)[parts.offset : parts.offset + n + 1]
    data = np.frombuffer(parts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if n else np.zeros(0, np.uint8)
    return data.view(kind).reshape(n, -1)


def usable(df: DataFrame, id: str, vector: str, version: str, width: int) -> DataFrame:
    """(id, vec): the unit vector of each id's latest usable row as 16-bit numbers and their scale."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
            v = v[good]
            v /= np.abs(v).max(axis=1, keepdims=True) if len(v) else 1
            coded = np.rint(v * 32767).astype(np.int16)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), _binary(coded)], ["id", "version", "vec"])

    whole = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull()) & F.col(id).isNotNull()
    rows = df.where(whole).select(F.col(id).cast("string").alias("id"), F.col(version).cast("string").alias("version"), F.col(vector).cast("array<float>").alias("v"))
    # the joins below ask for ids that are not null: asked here, all uses share one plan and its exchange
    rows = rows.mapInArrow(unit, "id string, version string, vec binary").where(F.col("id").isNotNull())
    return rows.groupBy("id").agg(F.max_by("vec", F.struct("version", "vec")).alias("vec"))


def placed(vectors: DataFrame, width: int) -> DataFrame:
    """(curve, place, tie, id, code): each vector on every curve."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, shifts = _directions(width)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), np.int16).astype(np.float32)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            y = v @ q[:, : max(CODE, min(width, CURVES * DIMENSIONS))]
            code = y[:, :CODE] / np.maximum(np.linalg.norm(y[:, :CODE], axis=1, keepdims=True), 1e-9)
            codes = _binary(np.clip(np.rint(code * 300), -127, 127).astype(np.int8))
            for c in range(CURVES):
                at = (np.arange(DIMENSIONS) + c * DIMENSIONS) % y.shape[1]
                cells = np.floor((y[:, at] * np.sqrt(width) / 6 + 0.5 + shifts[c]) * (1 << BITS))
                key = hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), b.column(0), codes], ["curve", "place", "id", "code"])

    rows = vectors.mapInArrow(place, "curve int, place bigint, id string, code binary")
    return rows.withColumn("tie", F.xxhash64("id"))


def candidates(places: DataFrame, k: int, least: float | None) -> DataFrame:
    """(id_a, id_b, near), id_a < id_b: pairs that lie close on some curve, with their codes' similarity.

    Each row keeps its best ``k`` and as many again in reserve; with ``least``, only pairs that
    can reach that similarity.
    """
    reserve = 2 * k

    def pairs(ids: np.ndarray, unit: np.ndarray, first: int) -> tuple[list, list, list]:
        left, right, near = [], [], []
        for s in range(first, len(ids), BLOCK):
            e, lo = min(s + BLOCK, len(ids)), max(0, s - BLOCK - WINDOW)
            score = unit[s:e] @ unit[lo:e].T
            own = np.arange(s, e) - lo
            score[np.arange(e - s), own] = -2
            if score.shape[1] > reserve:
                bar = np.partition(score, -reserve, axis=1)[:, -reserve][:, None]
            else:
                bar = np.full((e - s, 1), -1.5, np.float32)
            keep = score >= (bar if least is None else np.maximum(bar, least - MARGIN))
            i, j = np.nonzero(keep)
            left.append(ids[i + s]), right.append(ids[j + lo]), near.append(score[i, j])
        return left, right, near

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_ids, tail, curve = np.zeros(0, object), np.zeros((0, CODE), np.float32), -1
        for b in batches:
            curves = b.column(0).to_numpy(zero_copy_only=False)
            ids = np.array(b.column(1).to_pylist(), dtype=object)
            unit = _matrix(b.column(2), np.int8).astype(np.float32)
            unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
            left, right, near = [], [], []
            starts = [0, *(np.flatnonzero(np.diff(curves)) + 1), len(curves)]
            for s, e in zip(starts, starts[1:]):
                if s == e:
                    continue
                if curves[s] != curve:
                    tail_ids, tail, curve = tail_ids[:0], tail[:0], curves[s]
                own_ids, own = np.concatenate([tail_ids, ids[s:e]]), np.concatenate([tail, unit[s:e]])
                for all_, new in zip((left, right, near), pairs(own_ids, own, len(tail_ids))):
                    all_ += new
                tail_ids, tail = own_ids[-(BLOCK + WINDOW) :], own[-(BLOCK + WINDOW) :]
            if left and sum(map(len, left)):
                a, c, n = np.concatenate(left), np.concatenate(right), np.concatenate(near)
                low = a < c
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(low, a, c), pa.string()), pa.array(np.where(low, c, a), pa.string()), pa.array(n.astype(np.float32))], ["id_a", "id_b", "near"]
                )

    order = ["curve", "place", "tie"]
    rows = places.repartitionByRange(*order).sortWithinPartitions(*order).select("curve", "id", "code")
    found = rows.mapInArrow(scan, "id_a string, id_b string, near float")
    return found.groupBy("id_a", "id_b").agg(F.max("near").alias("near"))


def similar(df: DataFrame, id: str, vector: str, version: str, k: int = 10, least: float | None = None, width: int = 384) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: pairs where one is among the other's ``k`` most similar.

    ``least`` leaves out pairs of a smaller cosine.  Of each id's candidates the best 2k by codes
    are reranked with full vectors.
    """
    vectors = usable(df, id, vector, version, width)
    members = folded(vectors)
    vectors = distinct(vectors, members)
    near = candidates(placed(vectors, width), k, least)
    if least is None:
        near = _best(near, "near", 2 * k)

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (_matrix(b.column(i), np.int16).astype(np.float64) for i in (2, 3))
            s = (a * c).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (c * c).sum(axis=1)) if len(a) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["id_a", "id_b", "similarity"])

    side = lambda x: vectors.select(F.col("id").alias(f"id_{x}"), F.col("vec").alias(f"vec_{x}"))
    full = near.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", "vec_a", "vec_b")
    exact = full.mapInArrow(cosine, "id_a string, id_b string, similarity double")
    if least is not None:
        exact = exact.where(F.col("similarity") >= least)
    lists = _sides(exact, "similarity", k).select("x", "y", "similarity")
    pairs = with_copies(lists, members, k).select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b"), "similarity")
    return pairs.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def folded(vectors: DataFrame) -> DataFrame:
    """(id, rep, n): of each id the smallest id with an equal vector, and its place among those."""
    same = Window.partitionBy("_q_h").orderBy("id")
    rows = vectors.select("id", F.unhex(F.sha2("vec", 256)).alias("_q_h"))
    return rows.select("id", F.first("id").over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("rep"), F.row_number().over(same).alias("n"))


def distinct(vectors: DataFrame, members: DataFrame) -> DataFrame:
    return vectors.join(members.where("n = 1").select("id"), "id", "left_semi")


def with_copies(lists: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, neighbor, rank, similarity) of all ids, from (x, y, similarity): at most ``k`` others of each distinct vector.

    Of a group of copies no more than its first k + 1 ids can be among anyone's first ``k``.
    """
    heads = members.where(F.col("n") <= k + 1)
    entry = F.struct((-F.col("similarity")).alias("minus"), F.col("id").alias("neighbor"))
    own = heads.withColumn("similarity", F.lit(1.0)).select("rep", entry.alias("e"))
    others = lists.join(heads.select(F.col("rep").alias("y"), "id"), "y").select(F.col("x").alias("rep"), entry.alias("e"))
    # at most k + 1 copies and k heads of each of k others come together
    top = own.unionByName(others).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("e")), 1, k + 1).alias("top"))
    left = F.slice(F.filter("top", lambda e: e["neighbor"] != F.col("id")), 1, k)
    rows = members.select("id", "rep").join(top, "rep").select("id", F.posexplode(left).alias("at", "e"))
    return rows.select("id", F.col("e.neighbor").alias("neighbor"), (F.col("at") + 1).alias("rank"), (-F.col("e.minus")).alias("similarity"))


def fitted(sample: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per curve of :func:`nearest` the directions and the offsets of its cells.

    The directions lie in the subspace in which a sample of unit vectors varies most, turned
    differently for each curve, and the cells are shifted: what one curve parts, another keeps.
    """
    width = sample.shape[1]
    centred = sample - (sample.mean(axis=0) if len(sample) else 0)
    base = np.linalg.eigh(centred.T.astype(np.float64) @ centred)[1][:, ::-1][:, : min(SPACE, width)]
    rng, out = np.random.default_rng(SEED), []
    for _ in range(TURNS):
        turn = np.linalg.qr(rng.standard_normal((base.shape[1],) * 2))[0][:, :TURNED]
        q = (base @ turn).astype(np.float32)
        y = sample @ q if len(sample) else np.zeros((1, q.shape[1]), np.float32)
        low, high = np.quantile(y, 0.001), np.quantile(y, 0.999)
        scale = 0.84 / max(high - low, 1e-6)
        out.append((q * np.float32(scale), (0.08 - low * scale + rng.uniform(-0.08, 0.08, q.shape[1])).astype(np.float32)))
    return out


def windows(places: DataFrame, k: int) -> DataFrame:
    """(x, ys, sims): per row of each curve the ``k`` most similar ones of the window around it.

    A task walks along a stretch of a curve; a row is held until REACH rows lie behind it, and gives
    its list then.  Similarities are those of the whole vectors.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, curve = None, -1
        no, unit = np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
        sims, ys = np.zeros((0, k), np.float32), np.zeros((0, k), np.int64)

        def given(n: int) -> pa.RecordBatch:
            nonlocal no, unit, sims, ys
            full = sims[:n] > -2
            ends = pa.array(np.concatenate([[0], np.cumsum(full.sum(axis=1))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[:n][full])) for v in (ys, sims)]
            out = pa.RecordBatch.from_arrays([pa.array(no[:n]), *lists], ["x", "ys", "sims"])
            no, unit, sims, ys = no[n:], unit[n:], sims[n:], ys[n:]
            return out

        def add(new: np.ndarray, vectors: np.ndarray) -> None:
            nonlocal no, unit, sims, ys
            held = len(no)
            no, unit = np.concatenate([no, new]), np.concatenate([unit, vectors])
            score = vectors @ unit.T
            score[np.arange(len(new)), held + np.arange(len(new))] = -3
            # what the new rows find: the best of the window
            own, other = np.full((len(new), k), -3, np.float32), np.zeros((len(new), k), np.int64)
            m = min(k, score.shape[1])
            at = np.argpartition(-score, m - 1, axis=1)[:, :m]
            own[:, :m], other[:, :m] = np.take_along_axis(score, at, axis=1), no[at]
            # what the rows before them find among the new: all that beats the last of their lists
            i, j = np.nonzero(score[:, :held] > sims.min(axis=1)[None, :])
            row, sim, name = np.concatenate([np.repeat(np.arange(held), k), j]), np.concatenate([sims.ravel(), score[i, j]]), np.concatenate([ys.ravel(), new[i]])
            order = np.lexsort((-sim, row))
            first = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
            sims, ys = np.concatenate([sim[first].reshape(held, k), own]), np.concatenate([name[first].reshape(held, k), other])

        for b in batches:
            curves, numbers = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            v = _matrix(b.column(2), np.int16).astype(np.float32)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            if width is None:
                width, unit = v.shape[1], np.zeros((0, v.shape[1]), np.float32)
            starts = [0, *(np.flatnonzero(np.diff(curves)) + 1), len(curves)]
            for s, e in zip(starts, starts[1:]):
                if s < e and curves[s] != curve:
                    if len(no):
                        yield given(len(no))
                    curve = curves[s]
                for i in range(s, e, STEP):
                    add(numbers[i : min(i + STEP, e)], v[i : min(i + STEP, e)])
                    if len(no) > REACH:
                        yield given(len(no) - REACH)
        if len(no):
            yield given(len(no))

    return places.select("curve", "no", "vec").mapInArrow(scan, "x bigint, ys array<bigint>, sims array<float>")


def nearest(df: DataFrame, id: str, vector: str, version: str, k: int = 10, width: int = 384) -> DataFrame:
    """(id, neighbor, rank, similarity): the ``k`` most similar others of each id that some curve brings near.

    Every vector takes part.  The curves' directions are fitted on at most FIT vectors (those of the
    least hash); windows of REACH rows before and behind a row are compared by whole vectors, so that
    work and shuffle grow with the number of vectors.
    """
    kept = _kept(df, id, vector, version, width)
    return with_copies(_lists(kept, k, width), kept.select("id", "rep", "n"), k)


def _kept(df: DataFrame, id: str, vector: str, version: str, width: int) -> DataFrame:
    """(id, rep, n, vec, no): one written table, so that the vectors move once; copies have no vector there."""
    vectors = usable(df, id, vector, version, width)
    return written(vectors.join(folded(vectors), "id").select("id", "rep", "n", F.when(F.col("n") == 1, F.col("vec")).alias("vec"), F.monotonically_increasing_id().alias("no")))


def _lists(kept: DataFrame, k: int, width: int) -> DataFrame:
    """(x, y, similarity): at most ``k`` others of each distinct vector."""
    own = kept.where("n = 1")
    rows = own.orderBy(F.xxhash64("id"), "id").select("vec").limit(FIT).toArrow()
    sample = _matrix(rows.column(0), np.int16).astype(np.float32) if rows.num_rows else np.zeros((0, width), np.float32)
    curves = fitted(sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-9))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1), np.int16).astype(np.float32)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                for c, (q, offset) in enumerate(curves):
                    cells = np.floor((v @ q + offset) * (1 << FINE))
                    key = hilbert_keys(np.clip(cells, 0, (1 << FINE) - 1).astype(np.int64), FINE)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), b.column(0), b.column(1)], ["curve", "place", "no", "vec"])

    places = own.select("no", "vec").mapInArrow(place, "curve int, place bigint, no bigint, vec binary")
    # stretches many times as long as a window: rows at their ends are in the middle on other curves
    parts = max(1, -(-own.count() * TURNS // (STRETCH * REACH)))
    order = ["curve", "place", "no"]
    lists = windows(places.repartitionByRange(parts, *order).sortWithinPartitions(*order), k)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, sims = b.column(1), b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(ys.offsets.to_numpy()))
            y, sim = ys.flatten().to_numpy(zero_copy_only=False), sims.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((-sim, y, row))
            row, y, sim = row[order], y[order], sim[order]
            once = np.concatenate([[True], (row[1:] != row[:-1]) | (y[1:] != y[:-1])])[: len(row)]
            row, y, sim = row[once], y[once], sim[once]
            order = np.lexsort((y, -sim, row))
            row, y, sim = row[order], y[order], sim[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            x = b.column(0).to_numpy(zero_copy_only=False)[row[top]]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y[top]), pa.array(np.round(sim[top].astype(np.float64), 6))], ["x", "y", "similarity"])

    # at most k of each curve come together
    merged = lists.groupBy("x").agg(F.flatten(F.collect_list("ys")).alias("ys"), F.flatten(F.collect_list("sims")).alias("sims")).mapInArrow(best, "x bigint, y bigint, similarity double")
    names = lambda c: own.select(F.col("no").alias(c), F.col("id").alias(f"{c}_id"))
    return merged.join(names("x"), "x").join(names("y"), "y").select(F.col("x_id").alias("x"), F.col("y_id").alias("y"), "similarity")


def recall(df: DataFrame, id: str, vector: str, version: str, k: int = 10, width: int = 384, every: int = 50) -> DataFrame:
    """(queries, wanted, found, recall): the lists of :func:`nearest` against the exact search of a stated set of queries.

    The queries, one in ``every`` of the distinct vectors by hash, are cut into blocks, and each block
    passes over all vectors once.
    """
    kept = _kept(df, id, vector, version, width)
    files = sorted(kept.inputFiles())

    def tiles() -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        for file in files:
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_file(path) as f:
                for b in parquet.ParquetFile(f).iter_batches(TILE, columns=["id", "vec"]):
                    yield b.filter(b.column("vec").is_valid())

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        v = _matrix(b.column("vec"), np.int16).astype(np.float32)
        return np.array(b.column("id").to_pylist(), dtype=object), v / np.linalg.norm(v, axis=1, keepdims=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            for s in range(0, block.num_rows, ROWS):
                ids, unit = read(block.slice(s, ROWS))
                best, names = np.full((len(ids), k), -3, np.float32), np.full((len(ids), k), None, object)
                for tile in tiles():
                    if tile.num_rows:
                        other, vectors = read(tile)
                        score = unit @ vectors.T
                        score[ids[:, None] == other[None, :]] = -3
                        all_, who = np.concatenate([best, score], axis=1), np.concatenate([names, np.broadcast_to(other, score.shape)], axis=1)
                        at = np.argpartition(-all_, k - 1, axis=1)[:, :k]
                        best, names = np.take_along_axis(all_, at, axis=1), np.take_along_axis(who, at, axis=1)
                row, col = np.nonzero(best > -2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.string()), pa.array(names[row, col], pa.string())], ["id", "neighbor"])

    asked = spread(kept.where("n = 1").where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", "vec"))
    true = asked.mapInArrow(search, "id string, neighbor string")
    got = _lists(kept, k, width).select(F.col("x").alias("id"), F.col("y").alias("neighbor"), F.lit(1).alias("hit"))
    rows = true.join(got, ["id", "neighbor"], "left")
    return rows.agg(F.countDistinct("id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"), F.try_divide(F.count("hit"), F.count("*")).alias("recall"))


def _sides(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """Pairs from both ends, with the rank at that end; the order is by score, then by the other id."""
    ends = F.array(F.struct(F.col("id_a").alias("x"), F.col("id_b").alias("y")), F.struct(F.col("id_b").alias("x"), F.col("id_a").alias("y")))
    sides = pairs.withColumn("_q_e", F.explode(ends)).select("id_a", "id_b", score, "_q_e.*")
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc(score), "y"))
    return sides.withColumn("_q_n", rank).where(F.col("_q_n") <= k)


def _best(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """Pairs that are among the first ``k`` of one of their ids."""
    return _sides(pairs, score, k).groupBy("id_a", "id_b").agg(F.max(score).alias(score))


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(id, neighbor, rank, similarity) of the pairs of :func:`similar`."""
    return _sides(pairs, "similarity", k).select(F.col("x").alias("id"), F.col("y").alias("neighbor"), F.col("_q_n").alias("rank"), "similarity")

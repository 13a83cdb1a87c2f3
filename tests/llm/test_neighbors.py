from __future__ import annotations

import numpy as np

from quarrykit.llm import neighbors

SCHEMA = "id string, embedding array<float>, created_at timestamp, note string"


def test_the_curve_visits_every_cell_by_unit_steps():
    for m, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * m), -1).reshape(-1, m)
        order = cells[np.argsort(neighbors.hilbert_keys(cells, bits))]
        assert sorted(neighbors.hilbert_keys(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((900, 384))
    near = base[rng.integers(0, 900, 900)] + rng.standard_normal((900, 384)) * 0.25
    v = np.concatenate([base, near]).astype(np.float32)
    rows = [(f"{i:05d}", x.tolist(), None, "") for i, x in enumerate(v)]
    got = {(r.id_a, r.id_b) for r in neighbors.similar(spark.createDataFrame(rows, SCHEMA), "id", "embedding", "created_at", 10, 0.9).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {tuple(sorted((f"{i:05d}", f"{j:05d}"))) for i in range(len(v)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.9}
    assert len(got & want) >= 0.97 * len(want) and not got - want


def test_unusable_vectors_repeats_and_copies(spark):
    one = [0.0] * 383 + [2.0]
    rows = [("a", one, None, ""), ("a", one, None, ""), ("b", [x * 3 for x in one], None, ""), ("c", None, None, ""), ("d", [0.0] * 384, None, ""), ("e", [float("nan")] + one[1:], None, ""), ("f", one[:-1], None, ""), (None, one, None, ""), ("g", [None] + one[1:], None, ""), ("h", [float("inf")] + one[1:], None, "")]
    got = [tuple(r) for r in neighbors.similar(spark.createDataFrame(rows, SCHEMA), "id", "embedding", "created_at", 10, 0.9).collect()]
    assert [(a, b, round(s, 6)) for a, b, s in got] == [("a", "b", 1.0)]


def test_many_equal_vectors_keep_k_neighbours_each(spark):
    one = np.eye(384, dtype=np.float32)[0].tolist()
    df = spark.createDataFrame([(f"{i:04d}", one, None, "") for i in range(700)], SCHEMA)
    ranked = neighbors.ranked(neighbors.similar(df, "id", "embedding", "created_at", 3, 0.9), 3)
    assert {r.n for r in ranked.groupBy("id").count().withColumnRenamed("count", "n").collect()} == {3}


def _brute(v, k):
    """(id, neighbor, rank) by cosine; equal vectors have similarity 1, ties go to the smaller id."""
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    return s, {(f"{i:05d}", f"{j:05d}", r + 1) for i in range(len(v)) for r, j in enumerate(np.lexsort((np.arange(len(v)), -s[i]))[:k])}


def test_copies_are_folded_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(384)
    # twins around a large group of copies: the nearest of each lies beyond the group or beside it
    around = base + rng.standard_normal((30, 384)) * 0.3
    twins = around + rng.standard_normal((30, 384)) * 0.05
    v = np.concatenate([around, np.tile(base, (700, 1)), twins])[rng.permutation(760)].astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", x.tolist(), None, "") for i, x in enumerate(v)], SCHEMA)
    s, want = _brute(v, 5)
    got = {(r.id_a, r.id_b) for r in neighbors.similar(df, "id", "embedding", "created_at", 5, 0.9).collect()}
    assert got == {tuple(sorted((a, b))) for a, b, _ in want if s[int(a), int(b)] >= 0.9}


def test_all_nearest_are_found_without_a_least_similarity(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1500, 384)).astype(np.float32)
    v[1300:] = v[rng.integers(0, 20, 200)]
    df = spark.createDataFrame([(f"{i:05d}", x.tolist(), None, "") for i, x in enumerate(v)], SCHEMA)
    got = {(r.id, r.neighbor, r["rank"]) for r in neighbors.nearest(df, "id", "embedding", "created_at", 10).collect()}
    want = _brute(v, 10)[1]
    # 16-bit coordinates may exchange neighbours of almost the same similarity; all rows lie in one window
    assert len(got) == len(want) == 15000 and len({x[:2] for x in got} & {x[:2] for x in want}) >= 0.999 * 15000


def test_the_registered_query_gives_every_usable_chunk_ten(spark):
    from quarrykit.llm.queries import registry
    from tests.conftest import DATA

    rows = registry.queries["p6_neighbors"](spark, DATA)
    n = neighbors.usable(spark.read.parquet(f"{DATA}/code_chunks.parquet"), "id", "embedding", "created_at", 384).count()
    assert [tuple(r) for r in rows.groupBy("id").count().groupBy("count").count().collect()] == [(10, n)]


def test_recall_of_the_curves_when_windows_are_narrow(spark, monkeypatch):
    # forty clusters whose members are about equally near to each other; a window holds a tenth of all rows
    rng = np.random.default_rng(8)
    v = rng.standard_normal((40, 384))[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 384)) * 0.9
    df = spark.createDataFrame([(f"{i:05d}", x.tolist(), None, "") for i, x in enumerate(v.astype(np.float32))], SCHEMA)
    monkeypatch.setattr(neighbors, "REACH", 400)
    monkeypatch.setattr(neighbors, "STEP", 200)
    (row,) = neighbors.recall(df, "id", "embedding", "created_at", 10).collect()
    assert row.wanted == row.queries * 10 and row.queries >= 40 and row.recall >= 0.9

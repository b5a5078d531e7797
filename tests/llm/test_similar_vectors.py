from __future__ import annotations

import tracemalloc

import numpy as np

from mnemospark.llm import similar_vectors as V


def brute(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = (x @ x.T).round(12)
    return {i: [j for _, j in sorted((-c[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]] for a, i in enumerate(ids)}


def test_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 300)
    monkeypatch.setattr(V, "CELL", 100)
    monkeypatch.setattr(V, "PER_CELL", 4)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12 if i % 3 else 0] + 0.4 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # a large group of equal vectors
    bad = [(2000, None), (2001, [0.0] * 24), (rows[0][0], rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, vec array<float>, nbr_id string")
    got: dict[int, list[int]] = {}
    for r in V.nearest_vectors(df).collect():
        got.setdefault(r["vec_id"], []).append(r["nbr_id"])
    want = brute(rows, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (10 * len(want)) > 0.97
    assert sorted(got[1039]) == [5, *range(1000, 1009)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (9, [1.0])], "vec_id long, vec array<float>")
    got = sorted((r["vec_id"], r["nbr_id"]) for r in V.nearest_vectors(df).collect())
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert V.nearest_vectors(df.limit(0)).count() == 0


def test_a_cell_is_searched_whole():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 32)) + 2 * rng.standard_normal((9, 32))[rng.integers(0, 9, 900)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, other, cosine = V.search_block(x, np.arange(900), x[:200], 5)
    want = np.argsort(-(x[:200] @ x.T), axis=1, kind="stable")[:, :5]
    assert len(q) == 1000 and np.mean([len(set(other[q == k]) & set(want[k])) for k in range(200)]) > 4.95
    assert np.allclose(cosine, (x[q] * x[other]).sum(axis=1))


def test_cells_are_fitted_in_bounded_memory():
    x = np.random.default_rng(5).standard_normal((40_000, 16)).astype(np.float32)
    tracemalloc.start()
    centres = V.fit_cells(x, 2_500)  # all distances at once are 400 MB
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert centres.shape == (2_500, 16) and most < 60e6


def test_the_driver_gets_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(V, "SAMPLE_VALUES", 3_000)
    monkeypatch.setattr(V, "CELL", 40)
    seen = []
    fit = V.fit_cells
    monkeypatch.setattr(V, "fit_cells", lambda x, cells: seen.append((len(x), cells)) or fit(x, cells))
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((9, 8))[rng.integers(0, 9, 900)] + 0.3 * rng.standard_normal((900, 8))).astype(np.float32).tolist())]
    got: dict[int, list[int]] = {}
    for r in V.nearest_vectors(spark.createDataFrame(rows, "vec_id long, vec array<float>")).collect():
        got.setdefault(r["vec_id"], []).append(r["nbr_id"])
    want = brute(rows, 10)
    assert 300 < seen[0][0] < 450 and seen[0][1] > 10
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (10 * len(want)) > 0.97

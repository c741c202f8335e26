"""The inverted multi-index against brute force, where most rows are not visited."""

import numpy as np
import pytest

from citeloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def truth(v, every, k=10):
    asking = np.arange(0, len(v), every)
    apart = ann.squared(v[asking], v)
    apart[np.arange(len(asking)), asking] = np.inf
    return {int(q): set(np.argsort(d, kind="stable")[:k].tolist()) for q, d in zip(asking, apart)}


def found(frame, every):
    out = {}
    for r in ann.nearest(frame, 10, every).collect():
        out.setdefault(r["query_id"], set()).add(r["vec_id"])
    return out


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_with_most_rows_unvisited(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "LEAST_VISITED", 300)
    monkeypatch.setattr(ann, "SHELF_ROWS", 512)
    rng = np.random.default_rng(5)
    n, dim = 12_000, 24
    v = rng.normal(size=(n, dim))
    if kind == "clustered":
        v = 0.2 * v + rng.normal(size=(60, dim))[rng.integers(60, size=n)]
    v = v.astype("float32").astype(float)
    visited = []
    measured = ann.budget
    monkeypatch.setattr(ann, "budget", lambda *a: visited.append(measured(*a)) or visited[0])
    got, want = found(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA), 50), truth(v, 50)
    recall = np.mean([len(want[q] & got[q]) / 10 for q in want])
    assert recall >= 0.9 and visited[0] < {"isotropic": 0.5, "clustered": 0.1}[kind] * n


def test_recall_at_shipped_settings(spark, monkeypatch):
    """More rows than are ever visited whole, queries at every 50th."""
    rng = np.random.default_rng(8)
    n, dim = 25_000, 32
    v = (0.4 * rng.normal(size=(n, dim)) + rng.normal(size=(200, dim))[rng.integers(200, size=n)]).astype("float32").astype(float)
    visited = []
    measured = ann.budget
    monkeypatch.setattr(ann, "budget", lambda *a: visited.append(measured(*a)) or visited[0])
    got, want = found(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA), 50), truth(v, 50)
    assert np.mean([len(want[q] & got[q]) / 10 for q in want]) >= 0.9
    assert max(ann.LEAST_VISITED, visited[0]) < 0.5 * n


def test_one_vector_on_many_shelves(spark, monkeypatch):
    """A third of the rows are one vector: their cell is parted, and ties go to the smaller ids."""
    monkeypatch.setattr(ann, "LEAST_VISITED", 50)
    monkeypatch.setattr(ann, "SHELF_ROWS", 64)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1200, 6))
    v[::3] = 1.0
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(frame, 10, 300).collect()}
    assert [got[600, i] for i in range(1, 11)] == [(3 * i, 0.0) for i in range(10)]


def test_repeated_queries_and_other_dimensions(spark):
    rows = [(0, [1.0, 0.0]), (0, [9.0, 9.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0)]


def test_shelves_hold_whole_cells():
    size = np.array([3, 0, 4, 9, 1, 2, 5])
    first, parts = ann.shelves(size, 5)
    assert parts.tolist() == [1, 1, 1, 2, 1, 1, 1]
    assert first[[0, 2, 3, 4, 5, 6]].tolist() == [0, 1, 2, 4, 4, 5]

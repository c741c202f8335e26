"""Yinyang clusters against plain k-means in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from citeloom.llm import runtime, yinyang

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, scale=256, seed="2:"):
    """rows: (vec_id, integer components)."""
    whole = [(i, [math.floor(scale * v) for v in x]) for i, x in rows]
    first = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), x) for i, x in whole if i is not None)[:k]
    c = [x for _, x in first]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x: min((far(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in whole]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(whole, of) if o == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    got = [near(x) for _, x in whole]
    inertia = [sum(d for d, o in got if o == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    fits = lambda v: v if v < 2**63 else None
    return sorted((str(i), j, fits(d), fits(inertia[j]), fits(sum(inertia)), digest[j]) for (i, _), (d, j) in zip(whole, got))


def result(frame):
    return sorted((str(r["vec_id"]), *list(r)[1:]) for r in frame.collect())


@pytest.mark.parametrize(("k", "spread", "scale"), [(40, 1.0, 256), (25, 0.02, 256), (3, 1.0, 1), (30, 3e5, 256), (12, 1e9, 256), (9, 1e37, 256)])
def test_equals_plain_clusters(spark, k, spread, scale):
    """Clusters of any tightness, components beyond exact doubles included; small whole numbers give many ties."""
    rng = np.random.default_rng(k)
    middle = rng.normal(0, spread, (9, 5))
    x = middle[rng.integers(0, 9, 400)] + rng.normal(0, spread / 5, (400, 5))
    if scale == 1:
        x = rng.integers(-2, 3, (400, 5)).astype(float)
    rows = [(i if i % 50 else None, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[3], rows[3], (7, rows[4][1])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS vector", "2 AS upper", "0 AS moved")
    got = result(yinyang.clusters(frame, k=k, rounds=5, components=5, scale=scale))
    assert got == plain(rows, k, 5, scale)


def test_bounds_spare_work(monkeypatch):
    """Well apart, most vectors keep their centroid unseen; the answers are those of a whole scan in every round."""
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(0, 1, (40, 8))[rng.integers(0, 40, 3000)] * 4000 + rng.normal(0, 30, (3000, 8)))
    rows = [list(map(int, v)) for v in x[:40]]
    centres = yinyang.Centres(rows, yinyang.grouped(rows), [0.0] * 40)
    assert sorted(i for g in centres.groups for i in g) == list(range(40)) and 1 < len(centres.groups) <= 4
    state = yinyang.scan_all(x, centres.matrix(False), centres.groups)
    measured = []
    whole = yinyang.squared
    monkeypatch.setattr(yinyang, "squared", lambda a, b: measured.append(len(a)) or whole(a, b))
    for _ in range(4):
        moved = [[int(v) for v in np.floor(x[state[0] == j].mean(0))] if (state[0] == j).any() else r for j, r in enumerate(centres.rows)]
        drift = [math.dist(a, b) * (1 + yinyang.EPS) for a, b in zip(centres.rows, moved)]
        centres = yinyang.Centres(moved, centres.groups, drift)
        state = yinyang.reassign(x, centres.matrix(False), centres, *state)
        assert (state[0] == yinyang.scan_all(x, centres.matrix(False), centres.groups)[0]).all()
        d = np.sqrt(((x[:, None, :] - np.array(centres.rows)[None]) ** 2).sum(2))
        assert (state[1] >= d[np.arange(len(x)), state[0]] - 1e-6).all()
        d[np.arange(len(x)), state[0]] = np.inf
        assert all((state[2][:, g] <= d[:, members].min(1) + 1e-6).all() for g, members in enumerate(centres.groups))
    assert sum(measured) < 0.2 * 4 * 40 * len(x)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf])]
    assert yinyang.clusters(spark.createDataFrame(bad, SCHEMA), components=2).count() == 0
    assert yinyang.clusters(spark.createDataFrame([], SCHEMA), components=2).count() == 0
    assert yinyang.clusters(spark.createDataFrame([(None, [1.0, 2.0])], SCHEMA), components=2).count() == 0  # nothing to begin with
    few = [(9, [-0.001, 0.0]), (9, [-0.001, 0.0]), (8, [5.0, 1e-9]), (None, [5.0, 0.3])]
    got = result(yinyang.clusters(spark.createDataFrame(bad + few, SCHEMA), components=2))
    assert got == plain(few, 40, 5) and len(got) == 4
    huge = [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1e30, 2.0])]
    assert result(yinyang.clusters(spark.createDataFrame(huge, SCHEMA), k=2, components=2)) == plain(huge, 2, 5)


def test_no_table_is_left(spark):
    before = runtime.tables()
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(50)]
    yinyang.clusters(spark.createDataFrame(rows, SCHEMA), k=4, components=2).count()
    assert len(runtime.tables()) == len(before) + 1  # the result itself

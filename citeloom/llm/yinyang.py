"""K-means by Yinyang's grouped bounds, in exact integers.

The centroids are put in a few groups once. A vector keeps an upper bound of the distance to
its centroid and, for each group, a lower bound of that to any other centroid of the group.
When centroids move, bounds move by as much; a vector whose upper bound stays below all lower
ones keeps its centroid unseen, else only groups whose bound it reaches are looked into, and
of these only the centroids that may be nearer are measured.

Components are integers held in doubles, so that squared distances are exact up to 2^53, and
beyond in Python's integers. Bounds are rounded away from each other (EPS).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.runtime import scratch, spread, stored

#: Components up to which 64 squared differences add up exactly in doubles, and the bound of those that take part: that of floats times 256.
EXACT, LARGEST = 1 << 22, 2.0**136
EPS = 1e-12
#: Centroids a group, rounds of grouping them, and rows that bounds are kept for at once.
GROUP, GROUP_ROUNDS, ROWS = 10, 5, 4096
_LIMB = 60
_LONG = 1 << 63
_VECTOR = "vec_id long, vector array<double>, cluster int, upper double, lower array<double>, moved struct<counts: array<long>, top: array<long>, high: array<long>, low: array<long>>"


class Centres(NamedTuple):
    """Centroids as rows of exact integers, their groups, and how far each moved in the last round."""

    rows: list[list[int]]
    groups: list[list[int]]
    drift: list[float]

    def matrix(self, exact: bool) -> np.ndarray:
        return np.array(self.rows, object if exact else np.float64).reshape(len(self.rows), -1)


def grouped(rows: list[list[int]]) -> list[list[int]]:
    """Cluster the centroids themselves, a tenth as many groups as centroids."""
    x = np.array(rows, np.float64)
    n = max(1, len(rows) // GROUP)
    middle = x[:n].copy()
    for _ in range(GROUP_ROUNDS):
        of = ((x[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (of == g).any():
                middle[g] = x[of == g].mean(0)
    return [members for g in range(n) if (members := np.flatnonzero(of == g).tolist())]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


def _up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + EPS)


def _down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - EPS)


def scan_all(x: np.ndarray, c: np.ndarray, groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of each row, all centroids being measured."""
    if x.dtype == object:
        d = np.stack([squared(x, row) for row in c], axis=1)
    else:
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
    cluster = d.argmin(1)
    rows = np.arange(len(x))
    upper, low = _up(d[rows, cluster]), _down(d)
    low[rows, cluster] = np.inf
    return cluster, upper, np.stack([low[:, g].min(1) for g in groups], axis=1)


def reassign(x: np.ndarray, c: np.ndarray, centres: Centres, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) after the centroids have moved; ties go to the smaller number."""
    drift, groups = np.array(centres.drift), centres.groups
    cluster, upper = cluster.copy(), (upper + drift[cluster]) * (1 + EPS)
    shrunk = lower - np.array([drift[g].max() for g in groups])
    shrunk = np.where(shrunk > 0, shrunk * (1 - EPS), shrunk)
    rows = np.flatnonzero(upper >= shrunk.min(1))  # the global filter
    upper[rows] = _up(squared(x[rows], c[cluster[rows]]))
    rows = rows[upper[rows] >= shrunk[rows].min(1)]
    if not len(rows):
        return cluster, upper, shrunk
    own = cluster[rows]
    here, old, low = x[rows], lower[rows], shrunk[rows]
    first = squared(here, c[own])  # to the centroid so far
    best, chosen = first.copy(), own.copy()
    seen = np.full((len(rows), len(c)), np.inf)
    looked = low <= upper[rows, None]  # the group filter
    for g, members in enumerate(groups):
        for k in members:
            bound = np.where(old[:, g] > drift[k], (old[:, g] - drift[k]) * (1 - EPS), 0.0)
            other = looked[:, g] & (own != k)
            seen[other, k] = bound[other]
            at = np.flatnonzero(other & (bound <= _up(best)))  # the filter of single centroids
            d = squared(here[at], c[k])
            seen[at, k] = _down(d)
            nearer = (d < best[at]) | ((d == best[at]) & (k < chosen[at]))
            at, d = at[nearer.astype(bool)], d[nearer.astype(bool)]
            best[at], chosen[at] = d, k
    each = np.arange(len(rows))
    seen[each, own] = _down(first)
    seen[each, chosen] = np.inf
    of = np.empty(len(c), np.int64)
    for g, members in enumerate(groups):
        of[members] = g
        low[:, g] = np.where(looked[:, g], seen[:, members].min(1), low[:, g])
    left = np.flatnonzero((chosen != own) & ~looked[each, of[own]])  # its old centroid is one of a group not looked into
    low[left, of[own[left]]] = np.minimum(low[left, of[own[left]]], _down(first[left]))
    cluster[rows], upper[rows], shrunk[rows] = chosen, _up(best), low
    return cluster, upper, shrunk


def _moved(x: np.ndarray, was: np.ndarray | None, cluster: np.ndarray, k: int) -> dict[str, list[int]]:
    """What the rows that changed add to each centroid's count and sums, these in three limbs of 60 bits."""
    rows = np.arange(len(x)) if was is None else np.flatnonzero(was != cluster)
    sign = np.zeros((k, len(rows)), x.dtype)
    each = np.arange(len(rows))
    sign[cluster[rows], each] += 1
    if was is not None:
        sign[was[rows], each] -= 1
    sums = [int(v) for v in (sign @ x[rows]).ravel()] if len(rows) else [0] * (k * x.shape[1])
    limb = (1 << _LIMB) - 1
    return {"counts": [int(v) for v in sign.sum(1)] if len(rows) else [0] * k, "top": [v >> 2 * _LIMB for v in sums], "high": [v >> _LIMB & limb for v in sums], "low": [v & limb for v in sums]}


def _integers(column: pa.Array, c: Centres) -> tuple[np.ndarray, bool]:
    """The rows' components, and whether they are too large for doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    exact = len(flat) > 0 and (np.abs(flat).max() > EXACT or max(abs(v) for row in c.rows for v in row) > EXACT)
    return (np.array([int(v) for v in flat], object).reshape(x.shape), True) if exact else (x, False)


def _pass(given: DataFrame, centres: Centres, begun: bool, last: bool) -> DataFrame:
    """Assign every row; with its bounds and, in the first row of each block, what changed, or in the last pass with its distance."""
    wanted = "vec_id long, cluster int, distance long" if last else _VECTOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, exact = _integers(part.column(1), centres)
                c = centres.matrix(exact)
                if begun:
                    was = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                    lower = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(was), -1)
                    cluster, upper, lower = reassign(x, c, centres, was, part.column(3).to_numpy(zero_copy_only=False), lower)
                else:
                    was = None
                    cluster, upper, lower = scan_all(x, c, centres.groups)
                ids, clusters = part.column(0), pa.array(cluster, pa.int32())
                if last:
                    d = [int(v) for v in squared(x, c[cluster])]
                    yield pa.RecordBatch.from_arrays([ids, clusters, pa.array([v if v < _LONG else None for v in d], pa.int64())], names=["vec_id", "cluster", "distance"])
                    continue
                longs = pa.list_(pa.int64())
                moved = [_moved(x, was, cluster, len(c.tolist())), *[None] * (len(x) - 1)]
                arrays = [ids, part.column(1), clusters, pa.array(upper), pa.array(lower.tolist(), pa.list_(pa.float64())), pa.array(moved, pa.struct([(x, longs) for x in ("counts", "top", "high", "low")]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "vector", "cluster", "upper", "lower", "moved"])

    return given.mapInArrow(run, wanted)


def _sums(table: DataFrame, size: int) -> list[int]:
    """The counts, then the sums of all blocks' changes: size + size x components numbers, whatever the number of rows."""
    blocks = table.where("moved is not null").select("moved.*")

    def added(name: str) -> dict[int, int]:
        rows = blocks.select(F.posexplode(name)).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
        return {r["pos"]: int(r["total"]) for r in rows.collect()}

    counts, top, high, low = (added(x) for x in ("counts", "top", "high", "low"))
    return [counts[i] for i in range(size)] + [(top[i] << 2 * _LIMB) + (high[i] << _LIMB) + low[i] for i in range(len(low))]


def kept_vectors(embeddings: DataFrame, components: int, scale: int) -> DataFrame:
    """(vec_id, vector): rows with so many components, none null or beyond LARGEST, as floor(scale * x) in doubles."""
    fine = (F.size("embedding") == components) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale < LARGEST))
    times = lambda x: x.cast("double") * scale
    whole = F.transform("embedding", lambda x: F.when(F.abs(times(x)) < 2.0**52, F.floor(times(x)).cast("double")).otherwise(times(x)))
    return embeddings.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of the seed and their id, equal ones by their components; rows without an id are none."""
    rows = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    return [[int(v) for v in r["vector"]] for r in rows.orderBy("h", "vector").limit(k).collect()]


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one per vector kept.

    Vectors that are null, of another length, or hold a null or non-finite component take no
    part (nor do components beyond those of single precision, where sums would lose digits). With fewer vectors
    than k there are as many centroids; without any the result is empty. Repeated rows are
    vectors of their own; rows without a vec_id are assigned but never first centroids. A
    squared distance or sum that a long can't hold is null.

    Each round reads the vectors once with their bounds and writes them with the new ones to
    the shared folder, where the round before is deleted: a lost executor costs its tasks
    again, no round. Centroids come from what changed, summed per block before Spark adds up
    the blocks; only k x components numbers reach the driver.
    """
    spark: SparkSession = embeddings.sparkSession
    vectors = kept_vectors(embeddings, components, scale)
    rows = first_centroids(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not rows:
        return spark.createDataFrame([], schema)
    centres = Centres(rows, grouped(rows), [0.0] * len(rows))
    k = len(rows)
    with scratch(spark) as made:
        table, totals = stored(_pass(spread(vectors), centres, False, False), "round"), [0] * (k + k * components)
        for number in range(rounds):
            totals = [a + b for a, b in zip(totals, _sums(table, k))]
            moved = [[s // n for s in totals[k + i * components : k + (i + 1) * components]] if (n := totals[i]) else row for i, row in enumerate(centres.rows)]
            drift = [float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(x, y))))) * (1 + EPS) for x, y in zip(centres.rows, moved)]
            centres = Centres(moved, centres.groups, drift)
            if number + 1 < rounds:
                table = stored(_pass(table, centres, True, False), "round")
                made.forget_before_last()
        assigned = stored(_pass(table, centres, True, True), "assigned")
        made.keep_last()
    added = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    sums = {r["cluster"]: _LONG if r["beyond"] else int(r["s"]) for r in added.collect()}
    fits = lambda v: v if v < _LONG else None
    per = [(i, fits(sums.get(i, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(centres.rows)]
    told = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows

"""Nearest neighbours by an inverted multi-index.

Vectors are turned to their principal axes, which are dealt to two halves in turn, and both
halves are quantised separately; a cell is a pair of centroids. A query visits cells in the
order of summed squared distances of its halves to their centroids, drawn from a heap, until
the cells visited hold the budget of rows; these are reranked with exact distances. The
budget is measured, not set: for a few queries the true neighbours are found, and so many
rows are visited as the traversal needed to reach the wanted share of them.

Rows are dealt to shelves of whole cells, or of parts of a large cell, and a query asks each
shelf once, however many of its cells it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.runtime import cut, spread

#: Bounds of the sample that the codebooks are fitted on: rows, and numbers in them.
TRAIN_ROWS, TRAIN_VALUES = 20_000, 4_000_000
#: Centroids per half, at most.
MOST_CENTROIDS = 256
#: The share of true neighbours that visited rows should hold, and the queries it is measured with.
RECALL, PROBES = 0.95, 64
#: Rows that a query visits at least.
LEAST_VISITED = 5_000
#: Rows of a shelf, and queries that a task compares them with, at most.
SHELF_ROWS, QUERY_BLOCK = 4096, 1024


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = squared(points, centers).argmin(1)
        count = np.bincount(nearest, minlength=len(centers))
        total = np.stack([np.bincount(nearest, points[:, c], len(centers)) for c in range(points.shape[1])], axis=1)
        centers[count > 0] = total[count > 0] / count[count > 0][:, None]
    return centers


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to a query in double precision, summed in the order of the components."""
    total = np.zeros(len(rows))
    for c in range(rows.shape[1]):
        d = query[c] - rows[:, c]
        total += d * d
    return np.sqrt(total)


def best_of(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, asking: np.ndarray, k: int, open_: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the places of its k nearest rows and their exact distances, ties to the smaller id; own ids and closed pairs are out."""
    rough = squared(queries, rows)
    slack = 1e-6 * ((queries * queries).sum(1) + (rows * rows).sum(1).max(initial=0))  # rounding of the rough distances is far below
    out = []
    for i, query in enumerate(queries):
        may = ids != asking[i]
        if open_ is not None:
            may &= open_[i]
        at = np.flatnonzero(may)
        if len(at) > k and np.isfinite(rough[i]).all():
            near = rough[i, at]
            at = at[near <= np.partition(near, k - 1)[k - 1] + slack[i]]
        apart = exact(rows[at], query)
        order = np.lexsort((ids[at], apart))[:k]
        out.append((at[order], apart[order]))
    return out


def cell_order(left: np.ndarray, right: np.ndarray, size: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells by ascending left[i] + right[j] until they hold `enough` rows; size [i, j] counts a cell's rows.

    The multi-sequence traversal: a pair enters the heap once both pairs before it, one step
    down either order, have left it.
    """
    oi, oj = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    near, far, held = left[oi].tolist(), right[oj].tolist(), size[np.ix_(oi, oj)].tolist()
    heap, left_at, out, rows = [(near[0] + far[0], 0, 0)], [0] * len(oi), [], 0
    while heap and rows < enough:
        _, a, b = heapq.heappop(heap)
        if held[a][b]:
            out.append(int(oi[a] * size.shape[1] + oj[b]))
            rows += held[a][b]
        left_at[a] = b + 1
        if a + 1 < len(near) and left_at[a + 1] == b:
            heapq.heappush(heap, (near[a + 1] + far[b], a + 1, b))
        if b + 1 < len(far) and (a == 0 or left_at[a - 1] > b + 1):
            heapq.heappush(heap, (near[a] + far[b + 1], a, b + 1))
    return out


class Books(NamedTuple):
    """The rotation, the columns of the two halves after it, and their centroids."""

    axes: np.ndarray
    halves: tuple[np.ndarray, np.ndarray]
    centers: tuple[np.ndarray, np.ndarray]

    def sums(self, v: np.ndarray) -> list[np.ndarray]:
        turned = v @ self.axes
        return [squared(turned[:, h], c) for h, c in zip(self.halves, self.centers)]

    def cells(self, v: np.ndarray) -> np.ndarray:
        left, right = self.sums(v)
        return left.argmin(1) * len(self.centers[1]) + right.argmin(1)


def fit(points: np.ndarray, k: int) -> Books:
    """Principal axes of a sample, the strongest first, dealt to the halves in turn; k centroids for each."""
    scale = np.abs(points).max()
    spread_ = (points - points.mean(0)) / scale
    axes = np.linalg.eigh(spread_.T @ spread_)[1][:, ::-1] if points.shape[1] > 1 else np.eye(1)
    order = np.arange(points.shape[1])
    halves = (order[0::2], order[1::2])
    turned = points @ axes
    return Books(axes, halves, tuple(kmeans(turned[:, h], k) if len(h) else np.zeros((1, 0)) for h in halves))


def shelves(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) per cell: cells that follow each other share a shelf of up to `most` rows; a larger one has shelves of its own."""
    first, parts = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    shelf, held = 0, 0
    for cell in np.flatnonzero(size):
        n = int(size[cell])
        if held and held + n > most:
            shelf, held = shelf + 1, 0
        first[cell] = shelf
        if n > most:
            parts[cell] = -(-n // most)
            shelf += int(parts[cell])
        else:
            held += n
    return first, parts


def _vectors(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows that can take part: v not null or zero, all components finite."""
    v = F.col("embedding")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def budget(index: DataFrame, books: Books, size: np.ndarray, probes: pd.DataFrame, k: int) -> int:
    """Rows to visit so that RECALL of the probes' true k nearest are among them."""
    asking, wanted = probes["vec_id"].to_numpy(), _vectors(probes["v"])

    def truth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            v, ids = _vectors(frame["v"]), frame["vec_id"].to_numpy()
            if len(v):
                best = best_of(v, ids, wanted, asking, k)
                yield pd.concat([pd.DataFrame({"probe": i, "vec_id": ids[at], "cell": frame["cell"].to_numpy()[at], "apart": d}) for i, (at, d) in enumerate(best)])

    rank = F.row_number().over(Window.partitionBy("probe").orderBy("apart", "vec_id"))
    true = index.mapInPandas(truth, "probe int, vec_id long, cell long, apart double").withColumn("rank", rank).where(F.col("rank") <= k).select("probe", "cell").toPandas()  # PROBES * k rows
    left, right = books.sums(wanted)
    places = []
    for i, own in true.groupby("probe")["cell"]:
        sums = (left[i][:, None] + right[i][None, :]).ravel()
        order = np.argsort(sums, kind="stable")
        held = np.empty(len(sums), np.int64)
        held[order] = np.cumsum(size[order])
        places.append(held[own.to_numpy()])
    return int(np.quantile(np.concatenate(places), RECALL, method="higher")) if places else 0


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; a row is no candidate of
    queries of its own vec_id. Rows whose vector is null, zero, or holds null or non-finite
    components take no part, nor do null vec_ids, nor rows of another dimension than most
    have (the larger on a tie). Repeated rows are separate candidates; where rows repeat a
    query's vec_id, the least vector asks. Fewer than k candidates give fewer rows. Tables
    of up to LEAST_VISITED rows are searched whole.
    """
    given = spread(usable(vectors))
    kind = given.schema["v"].dataType.simpleString()
    sizes = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes["d"], sizes["count"]
    given = given.where(F.size("v") == dim)
    sample = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES + max(PROBES, min(TRAIN_ROWS, TRAIN_VALUES // dim))).toPandas()
    probes, fitting = sample.head(PROBES), sample.tail(max(len(sample) - PROBES, min(len(sample), PROBES)))  # apart, unless there are few rows
    books = fit(_vectors(fitting["v"]), int(min(MOST_CENTROIDS, max(2, round(total**0.5)))))
    wide = len(books.centers[1])
    cells = len(books.centers[0]) * wide

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(cell=books.cells(_vectors(frame["v"])))

    index = cut(given.mapInPandas(assign, f"vec_id long, v {kind}, cell long"))
    size = np.zeros(cells, np.int64)
    for row in index.groupBy("cell").count().collect():  # at most MOST_CENTROIDS ** 2 rows
        size[row["cell"]] = row["count"]
    whole = total <= LEAST_VISITED
    enough = total if whole else max(LEAST_VISITED, budget(index, books, size, probes, k))
    first, parts = shelves(size, SHELF_ROWS)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = size.reshape(-1, wide)
        for frame in frames:
            if not len(frame):
                continue
            left, right = books.sums(_vectors(frame["v"]))
            for i in range(len(frame)):
                seen = np.array(cell_order(left[i], right[i], table, enough), np.int64)
                reach = left[i, seen[-1] // wide] + right[i, seen[-1] % wide]  # of the last cell
                large = seen[parts[seen] > 1]
                asked = np.unique(np.concatenate([first[seen], *(first[c] + np.arange(parts[c]) for c in large)]))
                yield pd.DataFrame({"query_id": frame["vec_id"].iloc[i], "q": [frame["v"].iloc[i]] * len(asked), "reach": float("inf") if whole else reach * (1 + 1e-9), "shelf": asked})

    def shelve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell = frame["cell"].to_numpy()
            yield frame.assign(shelf=first[cell] + np.where(parts[cell] > 1, frame["salt"].to_numpy() % parts[cell], 0)).drop(columns="salt")

    parts_ = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be coalesced
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).repartition(parts_, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    asks = cut(queries.mapInPandas(visit, f"query_id long, q {kind}, reach double, shelf long"))
    blocks = asks.groupBy("shelf").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    salt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)).alias("salt")
    placed = index.select("vec_id", "v", "cell", salt).mapInPandas(shelve, f"vec_id long, v {kind}, cell long, shelf long")
    rows = placed.join(blocks, "shelf").select("vec_id", "v", "cell", F.col("shelf").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    asks = asks.join(blocks, "shelf").select("query_id", "q", "reach", "shelf", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"))

    def rerank(asked: pd.DataFrame, shelf: pd.DataFrame) -> pd.DataFrame:
        ids, v, cell = shelf["vec_id"].to_numpy(), _vectors(shelf["v"]), shelf["cell"].to_numpy()
        out = {"query_id": [], "vec_id": [], "score": []}
        for at in range(0, len(asked) if len(ids) else 0, 64):
            part = asked.iloc[at : at + 64]
            asking, q = part["query_id"].to_numpy(), _vectors(part["q"])
            left, right = books.sums(q)
            open_ = left[:, cell // wide] + right[:, cell % wide] <= part["reach"].to_numpy()[:, None]
            for query, (places, apart) in zip(asking, best_of(v, ids, q, asking, k, open_)):
                out["query_id"].append(np.full(len(places), query))
                out["vec_id"].append(ids[places])
                out["score"].append(apart)
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()})

    asks, rows = asks.repartition(parts_, "shelf", "block"), rows.repartition(parts_, "s", "b")
    found = asks.groupBy("shelf", "block").cogroup(rows.groupBy("s", "b")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

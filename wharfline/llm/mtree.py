"""Exact top-k search by inner product, with M-trees searched best first.

An extra coordinate sqrt(M^2 - |x|^2), M being the longest vector's length, turns the largest inner product into the
nearest neighbour, so that metric nodes bound it. Each block of vectors gets a tree of pages; a page has a routing
vector, a covering radius, and its entries' distances to that vector.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map

LEAF, FAN = 2048, 16


class MTree:
    """ids, points: int64 arrays; exact for components below 2^20 in magnitude."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.ids, self.points = ids, points
        lengths = (points.astype(np.float64) ** 2).sum(axis=1)
        self.most = float(lengths.max(initial=0))
        self.lifted = np.concatenate([points, np.sqrt(self.most - lengths)[:, None]], axis=1)  # while the tree is built
        self.order: list[np.ndarray] = []
        self.pages: list[tuple] = []  # (routing row, radius, children or entries, their distances to the routing row, is a leaf)
        self.root = self._build(np.arange(len(ids)), 0) if len(ids) else None
        del self.lifted

    def _far(self, rows: np.ndarray, row: int) -> np.ndarray:
        return np.sqrt(((self.lifted[rows] - self.lifted[row]) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, row: int) -> int:
        far = self._far(rows, row)
        if len(rows) <= LEAF or far.max() == 0:
            self.pages.append((row, float(far.max()), rows, far, True))
            return len(self.pages) - 1
        picks = rows[np.linspace(0, len(rows) - 1, FAN).astype(np.int64)]
        picks[0] = rows[np.argmax(far)]
        nearest = np.argmin(np.stack([self._far(rows, p) for p in picks]), axis=0)
        if (nearest == nearest[0]).all():  # equal picks can't part the rows
            nearest = (far > np.median(far)).astype(np.int64) if far.min() <= np.median(far) < far.max() else np.arange(len(rows)) % 2
        children = np.array([self._build(rows[nearest == i], int(picks[i])) for i in np.unique(nearest)])
        at = self._far(np.array([self.pages[c][0] for c in children]), row)
        self.pages.append((row, float(far.max()), children, at, False))
        return len(self.pages) - 1

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, score, id) of each query's k best, ids other than its own; ties to the smaller id.

        Every query has its own queue of pages, nearest bound first, and its own reach, the distance of its k-th best so far.
        In a round each query takes its next page; queries that take the same page are computed together.
        """
        m = len(queries)
        scores = np.full((m, k), np.iinfo(np.int64).min)
        ids = np.full((m, k), np.iinfo(np.int64).max)
        if self.root is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        asked = queries.astype(np.float64)
        lengths = (asked * asked).sum(axis=1)
        reach = np.full(m, np.inf)
        first = self._distances(asked, lengths, np.arange(m), np.array([self.pages[self.root][0]]))[:, 0].tolist()
        queues: list[list[tuple[float, int, float]]] = [[(max(0.0, d - self.pages[self.root][1]), self.root, d)] for d in first]
        active = range(m)
        while active:
            taken: dict[int, tuple[list[int], list[float]]] = {}
            limits, still = reach.tolist(), []
            for q in active:
                if queues[q] and queues[q][0][0] <= limits[q]:
                    _, page, d = heapq.heappop(queues[q])
                    members, far = taken.setdefault(page, ([], []))
                    members.append(q)
                    far.append(d)
                    still.append(q)
            for page, (members, far) in taken.items():
                if self.pages[page][4]:
                    self._enter_leaf(page, np.array(members), np.array(far), asked, owns, scores, ids, reach, lengths)
                else:
                    self._enter_node(page, members, np.array(far), asked, lengths, reach, queues)
            active = still
        row, at = np.nonzero(ids < np.iinfo(np.int64).max)
        return row, scores[row, at], ids[row, at]

    def _distances(self, asked: np.ndarray, lengths: np.ndarray, some: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of queries to vectors: |q|^2 + M^2 - 2 qx, as every lifted vector is M long."""
        return np.sqrt(np.maximum(0.0, lengths[some][:, None] + self.most - 2.0 * asked[some] @ self.points[rows].astype(np.float64).T))

    def _enter_node(self, page: int, members: list[int], d: np.ndarray, asked: np.ndarray, lengths: np.ndarray, reach: np.ndarray, queues: list) -> None:
        _, _, entries, far, _ = self.pages[page]
        radii = np.array([self.pages[c][1] for c in entries])
        some = np.array(members)
        may = np.abs(far[None] - d[:, None]) - radii <= reach[some][:, None]  # stored distances rule the others out
        children = np.flatnonzero(may.any(axis=0))
        if not len(children):
            return
        at = self._distances(asked, lengths, some, np.array([self.pages[c][0] for c in entries[children]]))
        bound = at - radii[children]
        for i, j in zip(*np.nonzero(may[:, children] & (bound <= reach[some][:, None])), strict=True):
            heapq.heappush(queues[members[i]], (max(0.0, bound[i, j]), int(entries[children[j]]), at[i, j]))

    def _enter_leaf(self, page: int, some: np.ndarray, d: np.ndarray, asked: np.ndarray, owns: np.ndarray, scores: np.ndarray, ids: np.ndarray, reach: np.ndarray, lengths: np.ndarray) -> None:
        _, _, rows, far, _ = self.pages[page]
        may = np.abs(far[None] - d[:, None]) <= reach[some][:, None]
        rows, may = rows[may.any(axis=0)], may[:, may.any(axis=0)]
        if not len(rows):
            return
        k = scores.shape[1]
        found = self._products(asked[some], rows)
        may &= (found >= scores[some][:, -1:]) & (self.ids[rows][None] != owns[some][:, None])
        better = np.flatnonzero(may.any(axis=1))
        if not len(better):
            return
        some = some[better]
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        both = np.concatenate([scores[some], np.where(may[better], found[better], low)], axis=1)
        names = np.concatenate([ids[some], np.where(may[better], self.ids[rows][None], high)], axis=1)
        best = np.lexsort((names, ~both), axis=1)[:, :k]
        scores[some], ids[some] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        full = ids[some, -1] < high
        near = np.sqrt(np.maximum(0.0, lengths[some[full]] + self.most - 2.0 * scores[some[full], -1]))
        reach[some[full]] = near + 1e-6 * (1 + near)

    def _products(self, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where no sum can pass 2^53, else in integers."""
        if self.most**0.5 * float(np.sqrt((asked * asked).sum(axis=1)).max(initial=0)) < 1 << 52:
            return (asked @ self.points[rows].astype(np.float64).T).astype(np.int64)
        return asked.astype(np.int64) @ self.points[rows].T


def _blocks(df: DataFrame, rows_each: int, make) -> tuple[DataFrame, int]:  # noqa: ANN001
    """(block, dim, data) with make(ids, matrix) pickled: one row for each block and dimension."""
    n = max(1, -(-df.count() // rows_each))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids: dict[int, list] = {}
        vectors: dict[int, list] = {}
        block = 0
        for b in batches:
            for i, v, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                block = at
                ids.setdefault(len(v), []).append(i)
                vectors.setdefault(len(v), []).append(v)
        for dim, own in ids.items():
            data = make(np.array(own, np.int64), np.array(vectors[dim], np.int64).reshape(len(own), dim))
            yield {"block": [block], "dim": [dim], "data": [pickle.dumps(data)]}

    return arrow_map(df.repartition(n).withColumn("block", F.spark_partition_id()), pack, "block int, dim int, data binary"), n


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, tree_rows: int = 16_384, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates with the highest integer inner product.

    Both tables: (vec_id long, vector array<long>), whose other columns are not read. Every tree meets every block of queries.
    Vectors of another length than the query's take no part, nor do rows with a null id, a null vector or a null component.
    The id names a row: candidates with the query's id are the query's own. Ties go to the smaller id; candidates that are
    repeated rows are ranked each. Repeated query rows give repeated results; fewer than k candidates give all, an empty
    table of either kind none. Vectors of any length may come; each length has its own trees.
    """
    whole = "vec_id is not null and vector is not null and forall(vector, x -> x is not null)"
    trees, n_trees = _blocks(vectors.filter(whole).select("vec_id", "vector"), tree_rows, MTree)
    asked, n_asked = _blocks(queries.filter(whole).select("vec_id", "vector"), query_rows, lambda ids, matrix: (ids, matrix.astype(np.int32) if np.abs(matrix).max(initial=0) < 1 << 31 else matrix))
    trees = trees.select(F.col("block").alias("tree"), "dim", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("part"), "data")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), "dim", F.col("block").alias("part"), "data")

    def search(tree: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        for t in tree.column("data").to_pylist():
            found = pickle.loads(t)
            for part, q in zip(queries.column("part").to_pylist(), queries.column("data").to_pylist(), strict=True):
                ids, matrix = pickle.loads(q)
                row, score, vec = found.search(matrix, ids, k)
                out.append([np.full(len(row), part), row, ids[row], vec, score])
        names = ("part", "at", "query_id", "vec_id", "score")
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({name: pa.array(np.concatenate([np.zeros(0, np.int64), *[o[i] for o in out]]), type=kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    keys = ("tree", "dim", "part")
    tasks = min(n_trees * n_asked, 1 << 16)
    trees, asked = trees.repartition(tasks, *keys), asked.repartition(tasks, *keys)  # small rows, long searches: a task for each
    found = trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "part int, at int, query_id long, vec_id long, score long")
    best = Window.partitionBy("part", "at", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours: a randomised k-d forest with best-bin-first search, and approximate k-means on it.

Trees split at the median of a dimension chosen at random among those of largest variance. A query walks all trees with
one queue ordered by the distance to the splitting planes and stops when the best point is nearer than the next plane, or
when it has compared with a share of all points.
"""

from __future__ import annotations

import heapq
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assign import Vocabulary, matrix
from .cluster import Result, lloyd

TREES, CANDIDATE_DIMENSIONS, LEAF, SHARE = 8, 5, 5, 0.05


class Forest:
    def __init__(self, points: np.ndarray, trees: int = TREES, leaf: int = LEAF, share: float = SHARE, seed: int = 0):
        self.points, self.leaf = points, leaf
        self.budget = max(leaf * trees, int(np.ceil(share * len(points))))
        rng = np.random.default_rng(seed)
        self.roots = [self._build(np.arange(len(points)), rng) for _ in range(trees)]

    def _build(self, at: np.ndarray, rng):
        """A leaf is an index array; a node is (dimension, split, left, right)."""
        if len(at) <= self.leaf:
            return at
        own = self.points[at]
        widest = np.argsort(-own.var(axis=0), kind="stable")[:CANDIDATE_DIMENSIONS]
        d = int(widest[rng.integers(len(widest))])
        split = float(np.median(own[:, d]))
        left = own[:, d] <= split
        if left.all() or not left.any():
            return at
        return d, split, self._build(at[left], rng), self._build(at[~left], rng)

    def search(self, q: np.ndarray) -> int:
        """Position of an (approximately) nearest point by Euclidean distance."""
        return self.counted(q)[0]

    def counted(self, q: np.ndarray) -> tuple[int, int]:
        """The same, and how many points the query was compared with."""
        queue = [(0.0, i, root) for i, root in enumerate(self.roots)]
        heapq.heapify(queue)
        order, best, at, seen, compared = len(queue), np.inf, -1, set(), 0
        while queue:
            plane, _, node = heapq.heappop(queue)
            if best <= plane or compared > self.budget and at >= 0:
                break
            while isinstance(node, tuple):
                d, split, left, right = node
                near, far = (left, right) if q[d] <= split else (right, left)
                order += 1
                heapq.heappush(queue, (abs(split - q[d]), order, far))
                node = near
            new = [i for i in node if i not in seen]
            if new:
                seen.update(new)
                compared += len(new)
                dist = np.sqrt(((self.points[new] - q) ** 2).sum(axis=1))
                k = int(dist.argmin())
                if dist[k] < best or dist[k] == best and new[k] < at:
                    best, at = float(dist[k]), int(new[k])
        return at, compared


def forest_assign(df: DataFrame, vocabulary: Vocabulary, vector: str = "embedding", seed: int = 0, **options) -> DataFrame:
    """``df`` with ``cid`` of an approximately nearest centroid."""
    shared = df.sparkSession.sparkContext.broadcast((vocabulary.ids, Forest(vocabulary.matrix, seed=seed, **options)))

    @F.arrow_udf("long")
    def run(v: pa.Array) -> pa.Array:
        ids, forest = shared.value
        x, whole = matrix(v, forest.points.shape[1])
        out = np.zeros(len(v), np.int64)
        out[whole] = [ids[forest.search(q)] for q in x]
        return pa.array(out, mask=~whole)

    return df.withColumn("cid", run(F.col(vector)))


class _Finder:
    """Assignment by forest inside a k-means iteration; forests are made once on the driver, one for each top word."""

    def __init__(self, vocabularies: dict[int, Vocabulary], seed: int, share: float):
        self.forests = {t: Forest(v.matrix, share=share, seed=seed) for t, v in vocabularies.items()}

    def __call__(self, top: int, x: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.forests[top].search, x), np.int64, len(x))


def approximate_kmeans(df: DataFrame, seeds: DataFrame, iterations: int = 20, delta: float = 0.001, stall: float = 0.001, vector: str = "embedding", seed: int = 0, share: float = SHARE, whole: bool = False) -> Result:
    """K-means whose assignment goes through the forest; also ends when the residual sum of squares stands still.

    ``whole``: for byte vectors, centroids are cut to whole numbers after each iteration.
    """
    start = Vocabulary.collect(seeds, "euclidean")
    if whole:
        start = Vocabulary(start.ids, np.trunc(start.matrix), start.metric)
    rows = df.select(vector, F.lit(0).cast("long").alias("_ls_top"))
    return lloyd(rows, {0: start}, vector, iterations, delta, lambda v: _Finder(v, seed, share), stall, whole)


def quality(points: np.ndarray, queries: np.ndarray, **options) -> float:
    """Share of queries for which the forest finds a point as near as the exact nearest."""
    return report(points, queries, **options)["precision"]


def report(points: np.ndarray, queries: np.ndarray, **options) -> dict[str, float]:
    """``precision`` as in ``quality``; ``compared``: points a query is compared with, as a share of all; ``speed_up``: time
    of the exact search over that of the forest."""
    forest, hits, compared = Forest(points, **options), 0, 0
    began = time.perf_counter()
    found = [forest.counted(q) for q in queries]
    middle = time.perf_counter()
    for q, (at, n) in zip(queries, found):
        exact = np.sqrt(((points - q) ** 2).sum(axis=1))
        hits, compared = hits + bool(np.isclose(exact[at], exact.min())), compared + n
    n = max(1, len(queries))
    return {"precision": hits / n, "compared": compared / n / max(1, len(points)), "speed_up": (time.perf_counter() - middle) / max(middle - began, 1e-9)}

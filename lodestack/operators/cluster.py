"""K-means family: flat, hierarchical and approximate, with the loop control on the driver.

One iteration is one pass over the vectors: every task assigns its vectors and adds them up, and gives a row for each
centroid it has seen (count, sum, sum of squares). Only these rows are shuffled, so the traffic is tasks x K x d, whatever
the number of vectors. The K x d model is the only thing that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assign import MODEL_NUMBERS, Vocabulary, assign, assign_two_level, matrix

MAX_ITERATIONS, DELTA = 20, 0.001

_PARTIAL = "top_id long, cid long, n long, total array<double>, squares double"


def first_k(df: DataFrame, k: int, order: str, vector: str = "embedding") -> DataFrame:
    """Deterministic seeds: the first k vectors in order, numbered from 0."""
    rows = df.where(F.col(vector).isNotNull()).select(order, vector).orderBy(order).limit(k)
    return rows.select((F.row_number().over(Window.orderBy(order)) - 1).cast("long").alias("cid"), F.col(vector).cast("array<double>").alias("centroid"))


def random_k(df: DataFrame, k: int, seed: int, vector: str = "embedding") -> DataFrame:
    """Uniform random seeds: k smallest of a seeded random number, without a global sort."""
    rows = df.where(F.col(vector).isNotNull()).select(vector, F.rand(seed).alias("_ls_r")).orderBy("_ls_r").limit(k)
    return rows.select((F.row_number().over(Window.orderBy("_ls_r")) - 1).cast("long").alias("cid"), F.col(vector).cast("array<double>").alias("centroid"))


def bernoulli_k(df: DataFrame, k: int, seed: int, vector: str = "embedding", factor: float = 1.5) -> DataFrame:
    """Seeds by Bernoulli sampling at rate ``factor * k / n``; samples that fall short are drawn again with another seed."""
    rows = df.where(F.col(vector).isNotNull()).select(vector)
    n = rows.count()
    if n < k:
        raise ValueError(f"{n} vectors are fewer than {k} seeds")
    while True:
        found = rows.sample(min(1.0, factor * k / n), seed).limit(k).collect()
        if len(found) == k:
            return df.sparkSession.createDataFrame([(i, [float(x) for x in r[0]]) for i, r in enumerate(found)], "cid long, centroid array<double>")
        seed, factor = seed + 1, factor * 1.5


def _partials(vectors: DataFrame, vocabularies: dict[int, Vocabulary], vector: str, search=None) -> DataFrame:
    """Per task, top word and centroid: count, sum and sum of squares of the vectors assigned to it."""
    shared = vectors.sparkSession.sparkContext.broadcast((vocabularies, search))

    def run(batches):
        models, finder = shared.value
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            tops = batch.column("_ls_top").to_numpy()
            for t in np.unique(tops):
                model = models.get(int(t))
                if model is None or not len(model.ids):
                    continue
                x, _ = matrix(batch.column(vector).filter(pa.array(tops == t)), model.matrix.shape[1])
                best = finder(int(t), x) if finder else model.nearest(x)[0]
                for k in np.unique(best[best >= 0]):
                    own = x[best == k]
                    s = sums.setdefault((int(t), int(model.ids[k])), [0, np.zeros(x.shape[1]), 0.0])
                    s[0], s[1], s[2] = s[0] + len(own), s[1] + own.sum(axis=0), s[2] + float((own**2).sum())
        rows = list(sums.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([t for (t, _), _ in rows], pa.int64()),
                pa.array([c for (_, c), _ in rows], pa.int64()),
                pa.array([s[0] for _, s in rows], pa.int64()),
                pa.array([s[1].tolist() for _, s in rows], pa.list_(pa.float64())),
                pa.array([s[2] for _, s in rows], pa.float64()),
            ],
            ["top_id", "cid", "n", "total", "squares"],
        )

    return vectors.mapInArrow(run, _PARTIAL)


def sums(vectors: DataFrame, vocabularies: dict[int, Vocabulary], vector: str = "embedding", search=None) -> DataFrame:
    """``(top_id, cid, n, mean, rss)``: new centroids and their residual sum of squares."""
    part = _partials(vectors, vocabularies, vector, search)
    each = part.select("top_id", "cid", F.posexplode("total").alias("i", "x")).groupBy("top_id", "cid", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy("top_id", "cid").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    size = part.groupBy("top_id", "cid").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    out = size.join(whole, ["top_id", "cid"]).withColumn("mean", F.transform("s", lambda s: s["x"] / F.col("n")))
    length = F.aggregate("mean", F.lit(0.0), lambda a, m: a + m * m)
    return out.select("top_id", "cid", "n", "mean", (F.col("squares") - F.col("n") * length).alias("rss"))


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old(cid, centroid)`` with the new centroid where there is one; a centroid without vectors stays."""
    fresh = new.select(F.col("cid").alias("_ls_cid"), F.col("centroid").alias("_ls_c"))
    return old.join(fresh, F.col("cid") == F.col("_ls_cid"), "left").select("cid", F.coalesce("_ls_c", "centroid").alias("centroid"))


@dataclass
class Result:
    vocabularies: dict[int, Vocabulary]
    iterations: int = 0
    converged: bool = False
    rss: list[float] = field(default_factory=list)


def _stalled(rss: list[float], tolerance: float) -> bool:
    """Three values or more, and the last is as the mean of the two before it."""
    if len(rss) < 3:
        return False
    mean = (rss[-2] + rss[-3]) / 2
    return mean > 0 and abs(rss[-1] - mean) / mean < tolerance


def lloyd(vectors: DataFrame, start: dict[int, Vocabulary], vector: str = "embedding", iterations: int = MAX_ITERATIONS, delta: float = DELTA, search: Callable | None = None, stall: float | None = None, whole: bool = False) -> Result:
    """Lloyd's iterations of several problems at once: ``vectors`` has the problem in ``_ls_top``.

    Ends when no centroid moves more than ``delta``, or (with ``stall``) when the residual sum of squares stands still.
    ``whole``: centroids are cut to whole numbers, as byte vectors have them.
    """
    out = Result(start)
    for _ in range(iterations):
        rows = sums(vectors, out.vocabularies, vector, search(out.vocabularies) if search else None).collect()
        place = {t: {int(c): k for k, c in enumerate(v.ids)} for t, v in out.vocabularies.items()}
        moved, after = 0.0, {t: Vocabulary(v.ids, v.matrix.copy(), v.metric) for t, v in out.vocabularies.items()}
        for r in rows:
            model = after[r.top_id]
            k = place[r.top_id][r.cid]
            new = np.trunc(r["mean"]) if whole else np.array(r["mean"])
            moved = max(moved, float(np.linalg.norm(new - model.matrix[k])))
            model.matrix[k] = new
        out.vocabularies, out.iterations = after, out.iterations + 1
        out.rss.append(float(sum(r.rss for r in rows)))
        out.converged = moved <= delta
        if out.converged or stall is not None and _stalled(out.rss, stall):
            break
    return out


def kmeans(df: DataFrame, seeds: DataFrame, metric: str = "cosine", iterations: int = MAX_ITERATIONS, delta: float = DELTA, vector: str = "embedding") -> Result:
    """Flat k-means from ``seeds(cid, centroid)``; the vocabulary has key 0."""
    return lloyd(df.select(vector, F.lit(0).cast("long").alias("_ls_top")), {0: Vocabulary.collect(seeds, metric)}, vector, iterations, delta)


def bottom_seeds(df: DataFrame, bot_k: int, order: str, vector: str = "embedding") -> dict[int, list]:
    """The first ``bot_k`` vectors of every top word, from ``df`` with ``top_id``; at most ``MODEL_NUMBERS`` numbers."""
    size = df.where("top_id is not null").agg(F.count_distinct("top_id"), F.max(F.size(vector))).first()
    if (size[0] or 0) * bot_k * (size[1] or 0) > MODEL_NUMBERS:
        raise ValueError("the bottom vocabularies are too large to be learned at once")
    rank = Window.partitionBy("top_id").orderBy(order)
    rows = df.where("top_id is not null").select("top_id", order, F.col(vector).cast("array<double>").alias("v")).withColumn("n", F.row_number().over(rank)).where(F.col("n") <= bot_k)
    out: dict[int, list] = {}
    for r in rows.orderBy("top_id", "n").collect():
        out.setdefault(r.top_id, []).append(r.v)
    return out


def hierarchical(df: DataFrame, top_k: int, bot_k: int, order: str, metric: str = "cosine", iterations: int = MAX_ITERATIONS, delta: float = DELTA, vector: str = "embedding") -> tuple[Vocabulary, dict[int, Vocabulary]]:
    """Two-level top-down k-means; all bottom problems run in the same jobs."""
    top = kmeans(df, first_k(df, top_k, order, vector), metric, iterations, delta, vector).vocabularies[0]
    split = assign(df.select(order, vector), top, vector).withColumnRenamed("cid", "top_id").drop("value")
    start = {t: Vocabulary(np.arange(len(v)), np.array(v, float), metric) for t, v in bottom_seeds(split, bot_k, order, vector).items()}
    below = lloyd(split.where("top_id is not null").select(vector, F.col("top_id").alias("_ls_top")), start, vector, iterations, delta).vocabularies
    return top, below


def bottom_table(spark, bottoms: dict[int, Vocabulary]) -> DataFrame:
    """``(top_id, cid, centroid)`` of all bottom vocabularies."""
    rows = [(int(t), int(i), c.tolist()) for t, v in sorted(bottoms.items()) for i, c in zip(v.ids, v.matrix)]
    return spark.createDataFrame(rows, "top_id long, cid long, centroid array<double>")


def merged(top: Vocabulary, bottoms: dict[int, Vocabulary], bot_k: int) -> Vocabulary:
    """All bottom centroids with their global ids ``top_id * bot_k + bot_id``."""
    ids = np.concatenate([t * bot_k + v.ids for t, v in sorted(bottoms.items())])
    return Vocabulary(ids, np.concatenate([v.matrix for _, v in sorted(bottoms.items())]), top.metric)


__all__ = ["Result", "assign_two_level", "bernoulli_k", "bottom_seeds", "bottom_table", "carry_over", "first_k", "hierarchical", "kmeans", "lloyd", "merged", "random_k", "sums"]

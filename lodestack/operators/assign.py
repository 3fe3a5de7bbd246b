"""Nearest-centroid joins: vectors to the words of a vocabulary.

The vocabulary is a model of K x d numbers: it is collected under a size bound, broadcast once, and every task computes
``X @ C.T`` over Arrow batches in blocks of ``ROWS`` rows and ``COLUMNS`` centroids, so vectors are never shuffled.
Beyond the bound there is the two-level form. With bottom vocabularies within the bound these are broadcast too; with a
table of bottom centroids, of any size, vectors are brought together by top word and each group meets its own matrix.
Ties go to the smallest id; a vector of length zero, of another dimension, or null has no nearest centroid by cosine
(null).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import save, small

#: Numbers in a vocabulary that a task may hold (doubles: 512 MB).
MODEL_NUMBERS = 64_000_000

#: Rows and centroids that are compared at a time (similarities: 32 MB).
ROWS, COLUMNS = 1024, 4096

#: Vectors of a top word that meet its bottom matrix in one task, about.
GROUP = 200_000


@dataclass
class Vocabulary:
    """Centroid ids and matrix."""

    ids: np.ndarray
    matrix: np.ndarray
    metric: str = "cosine"

    @classmethod
    def collect(cls, centroids: DataFrame, metric: str = "cosine") -> Vocabulary:
        """From ``centroids(cid, centroid)``; at most ``MODEL_NUMBERS`` numbers."""
        rows = centroids.select(F.col("cid").cast("long").alias("cid"), F.col("centroid").cast("array<double>").alias("c")).orderBy("cid")
        size = rows.agg(F.count("*"), F.max(F.size("c"))).first()
        if (size[0] or 0) * (size[1] or 0) > MODEL_NUMBERS:
            raise ValueError("the vocabulary is too large for one task: use the two-level join")
        found = rows.collect()
        if len({r.cid for r in found}) < len(found):
            raise ValueError("two centroids have the same id")
        return cls(np.array([r.cid for r in found], np.int64), np.array([r.c for r in found], float), metric)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the nearest centroid of each row (-1: none), and the similarity or distance."""
        best, value = np.full(len(x), -1), np.full(len(x), np.nan)
        for i in range(0, len(x), ROWS):
            part = x[i : i + ROWS]
            near, at = np.full(len(part), -np.inf), np.full(len(part), -1)
            for j in range(0, len(self.ids), COLUMNS):
                each = self._nearness(part, self.matrix[j : j + COLUMNS])
                k = each.argmax(axis=1)
                most = each[np.arange(len(part)), k]
                better = most > near  # an equal one that comes later doesn't win
                near[better], at[better] = most[better], k[better] + j
            found = at >= 0
            best[i : i + ROWS] = at
            if self.metric != "cosine" and found.any():
                near[found] = np.sqrt(((part[found] - self.matrix[at[found]]) ** 2).sum(axis=1))
            value[i : i + ROWS] = np.where(found, near, np.nan)
        return best, value

    def _nearness(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Cosine similarities, or half the squared centroid lengths less than the products: largest where nearest."""
        if self.metric == "cosine":
            scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
            with np.errstate(all="ignore"):
                return np.where(scale > 0, (x @ c.T) / scale, -np.inf)
        return x @ c.T - (c**2).sum(axis=1)[None, :] / 2


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list array that have ``dim`` numbers and no null, and a mask of these rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    whole = lengths == dim
    if not whole.all():
        column = column.filter(pa.array(whole))
    flat = column.flatten()
    if flat.null_count:
        x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        fine = ~np.isnan(x).any(axis=1)
        whole[np.flatnonzero(whole)[~fine]] = False
        return x[fine], whole
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim), whole


def _ids(v: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id, similarity or distance, and whether there is one, for each row."""
    n = len(column)
    ids, value, has = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    if v.matrix.ndim == 2 and n:
        x, whole = matrix(column, v.matrix.shape[1])
        best, near = v.nearest(x)
        at = np.flatnonzero(whole)
        ids[at], value[at], has[at] = np.append(v.ids, 0)[best], near, best >= 0
    return ids, value, has


def nearest(spark, vocabulary: Vocabulary, vector: Column) -> Column:
    """Column ``struct<cid, value>`` of the nearest centroid; null without one."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<cid:long,value:double>")
    def run(v: pa.Array) -> pa.Array:
        ids, value, has = _ids(shared.value, v)
        return pa.StructArray.from_arrays([pa.array(ids), pa.array(value)], ["cid", "value"], mask=pa.array(~has))

    return run(vector)


def assign(df: DataFrame, vocabulary: Vocabulary, vector: str = "embedding") -> DataFrame:
    """``df`` with ``cid`` and ``value`` of the nearest centroid (null without one)."""
    out = df.withColumn("_ls_near", nearest(df.sparkSession, vocabulary, F.col(vector)))
    return out.withColumns({"cid": F.col("_ls_near.cid"), "value": F.col("_ls_near.value")}).drop("_ls_near")


def assign_two_level(df: DataFrame, top: Vocabulary, bottoms: dict[int, Vocabulary] | DataFrame, bot_k: int, vector: str = "embedding") -> DataFrame:
    """``df`` with ``top_id``, ``bot_id`` and ``word = top_id * bot_k + bot_id``: topK + botK comparisons a vector.

    ``bottoms``: a vocabulary for each top word, or the table ``(top_id, cid, centroid)`` of all of them.
    """
    if isinstance(bottoms, DataFrame):
        return _by_top_word(df, top, bottoms, bot_k, vector)
    if sum(v.matrix.size for v in bottoms.values()) > MODEL_NUMBERS:
        raise ValueError("the bottom vocabularies are too large for one task: pass them as a table")
    shared = df.sparkSession.sparkContext.broadcast((top, bottoms))

    @F.arrow_udf("struct<top_id:long,bot_id:long>")
    def run(v: pa.Array) -> pa.Array:
        first, below = shared.value
        tops, _, has = _ids(first, v)
        bots, found = np.zeros(len(v), np.int64), np.zeros(len(v), bool)
        for t in np.unique(tops[has]):
            at = np.flatnonzero(has & (tops == t))
            if int(t) in below:
                bots[at], _, found[at] = _ids(below[int(t)], v.take(pa.array(at)))
        return pa.StructArray.from_arrays([pa.array(tops, mask=~has), pa.array(bots, mask=~found)], ["top_id", "bot_id"])

    out = df.withColumn("_ls_near", run(F.col(vector)))
    out = out.withColumns({"top_id": F.col("_ls_near.top_id"), "bot_id": F.col("_ls_near.bot_id")}).drop("_ls_near")
    return out.withColumn("word", F.col("top_id") * bot_k + F.col("bot_id"))


def _by_top_word(df: DataFrame, top: Vocabulary, bottoms: DataFrame, bot_k: int, vector: str) -> DataFrame:
    """The two-level join by a table of bottom centroids, keyed by top word.

    Each top word's matrix (botK x d numbers, within ``MODEL_NUMBERS``) is one row. A top word's vectors are counted and
    dealt to parts of about ``GROUP``, with a copy of its matrix for each, so a frequent top word is no single task.
    """
    d = top.matrix.shape[1]
    most = bottoms.groupBy("top_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most * d > MODEL_NUMBERS:
        raise ValueError("a top word's bottom vocabulary is too large for one task")
    metric = top.metric
    rows = assign(df.withColumn("_ls_v", F.col(vector)), top, vector).withColumnRenamed("cid", "top_id").drop("value")
    rows = save(rows.select("top_id", "_ls_v", F.struct(*df.columns).alias("_ls_row")), "tops")
    sizes = rows.groupBy("top_id").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_ls_parts"))
    sizes = save(sizes.select(F.coalesce("top_id", F.lit(-1)).alias("_ls_top"), "_ls_parts"), "sizes")
    rows = rows.join(small(sizes), F.coalesce("top_id", F.lit(-1)) == F.col("_ls_top"))
    rows = rows.withColumn("_ls_part", F.pmod(F.xxhash64("_ls_v", "_ls_row"), F.col("_ls_parts")).cast("int"))
    entry = F.array_sort(F.collect_list(F.struct("cid", "centroid")))
    models = bottoms.select(F.col("top_id").cast("long").alias("top_id"), F.col("cid").cast("long").alias("cid"), F.col("centroid").cast("array<double>").alias("centroid"))
    models = models.groupBy("top_id").agg(entry.alias("m")).join(small(sizes), F.col("top_id") == F.col("_ls_top"))
    models = models.select("top_id", F.explode(F.sequence(F.lit(0), F.col("_ls_parts") - 1)).alias("_ls_part"), "m")

    def run(key, vectors: pa.Table, model: pa.Table) -> pa.Table:
        bots, found = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), bool)
        if len(model):
            cells = model.column("m").combine_chunks().flatten()
            v = Vocabulary(cells.field("cid").to_numpy(), matrix(cells.field("centroid"), d)[0], metric)
            bots, _, found = _ids(v, vectors.column("_ls_v"))
        out = {"_ls_row": vectors.column("_ls_row"), "top_id": vectors.column("top_id"), "bot_id": pa.array(bots, mask=~found)}
        return pa.table(out)

    keyed = rows.select("top_id", "_ls_part", "_ls_v", "_ls_row")
    schema = f"_ls_row {keyed.schema['_ls_row'].dataType.simpleString()}, top_id long, bot_id long"
    out = keyed.groupBy("top_id", "_ls_part").cogroup(models.groupBy("top_id", "_ls_part")).applyInArrow(run, schema)
    return out.where("_ls_row is not null").select("_ls_row.*", "top_id", "bot_id").withColumn("word", F.col("top_id") * bot_k + F.col("bot_id"))

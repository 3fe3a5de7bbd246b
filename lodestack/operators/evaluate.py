"""Retrieval metrics on ``results(query, doc, rank)`` and ``judgments(query, doc, grade)``.

Grades are good, ok and junk: good and ok are relevant, junk documents are taken out of the results first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import without_junk

RELEVANT = ("good", "ok")


def judged(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """Results without junk, ranked anew, with ``rel`` 1 or 0."""
    clean = without_junk(results, judgments.where("grade = 'junk'"))
    relevant = judgments.where(F.col("grade").isin(*RELEVANT)).select("query", "doc", F.lit(1).alias("rel")).distinct()
    return clean.join(relevant, ["query", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def relevant_counts(judgments: DataFrame) -> DataFrame:
    return judgments.where(F.col("grade").isin(*RELEVANT)).groupBy("query").agg(F.countDistinct("doc").alias("n_relevant"))


def average_precision(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """``(query, n_relevant, ap)`` for every query with a relevant document: mean over them of the precision at their rank."""
    so_far = F.sum("rel").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gains = judged(results, judgments).withColumn("p", F.col("rel") * so_far / F.col("rank")).groupBy("query").agg(F.sum("p").alias("s"))
    out = relevant_counts(judgments).join(gains, "query", "left")
    return out.select("query", "n_relevant", F.round(F.coalesce("s", F.lit(0.0)) / F.col("n_relevant"), 6).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.agg(F.count("*").alias("n_queries"), F.round(F.avg("ap"), 6).alias("map"))


def judged_by_document(results: DataFrame, grades: DataFrame) -> DataFrame:
    """As ``judged``, for grades of documents, ``grades(doc, grade)``, that hold for every query."""
    clean = without_junk(results, grades.where("grade = 'junk'").select("doc"))
    relevant = grades.where(F.col("grade").isin(*RELEVANT)).select("doc", F.lit(1).alias("rel")).distinct()
    return clean.join(relevant, "doc", "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def precision_recall_f1(marked: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """``(query, precision, recall, f1)`` of the first n judged results; f1 is null if both are 0.

    ``counts(query, n_relevant)``, or one row ``counts(n_relevant)`` for all queries.
    """
    first = marked.where(F.col("rank") <= n).groupBy("query").agg(F.count("*").alias("k"), F.sum("rel").alias("hits"))
    both = first.join(counts, "query", "left") if "query" in counts.columns else first.join(F.broadcast(counts))
    r = F.coalesce(F.try_divide(F.col("hits"), F.col("n_relevant")), F.lit(0.0))
    both = both.withColumns({"p": F.col("hits") / F.col("k"), "r": r})
    f1 = F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return both.select("query", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def precision_at_k(results: DataFrame, labels: DataFrame, query_labels: DataFrame, k: int) -> DataFrame:
    """``(query, precision_at_k)``: share of the first k results with the query's label."""
    first = results.where(F.col("rank") <= k).join(labels, "doc").join(query_labels.withColumnRenamed("label", "wanted"), "query")
    hit = (F.col("label") == F.col("wanted")).cast("int")
    return first.groupBy("query").agg(F.round(F.sum(hit) / F.count("*"), 6).alias("precision_at_k"))


def precision_at_k_by_name(results: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``(query, precision_at_k)``: share of the first k results whose name holds the query's class, ``classes(query, class)``."""
    first = results.where(F.col("rank") <= k).join(classes, "query")
    hit = F.col("doc").cast("string").contains(F.col("class")).cast("int")
    return first.groupBy("query").agg(F.round(F.sum(hit) / F.count("*"), 6).alias("precision_at_k"))


def hit_at(results: DataFrame, expected: DataFrame, k: int = 5, excluded: DataFrame | None = None) -> DataFrame:
    """``(query, hit)``: 1 if the expected document is among the first k, else 0; -1 for an excluded query."""
    met = results.where(F.col("rank") <= k).join(expected, ["query", "doc"], "left_semi").select("query").distinct()
    out = expected.select("query").distinct().join(met.withColumn("hit", F.lit(1)), "query", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    if excluded is not None:
        out = out.join(excluded.select("query").distinct().withColumn("_ls_out", F.lit(True)), "query", "left")
        out = out.withColumn("hit", F.when(F.col("_ls_out"), -1).otherwise(F.col("hit"))).drop("_ls_out")
    return out


def accuracy(hits: DataFrame) -> DataFrame:
    """Hits over queries that are not excluded."""
    used = hits.where("hit >= 0")
    return used.agg(F.count("*").alias("n_queries"), F.round(F.try_divide(F.sum("hit"), F.count("*")), 6).alias("accuracy"))

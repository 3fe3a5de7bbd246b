"""Inverted index and ranked retrieval (TF-IDF with coordination and length norm).

``score(q, d) = coord * sum over t of qtf * sqrt(tf) * idf^2 / sqrt(len)``, ``idf = 1 + ln(N / (df + 1))`` and ``coord`` the
share of the query's clauses that match, repeats counted. Scores are rounded to six digits before ranking; ties go to the
smaller document id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import ends_with_any
from ..storage import save, small
from .bow import histogram

#: Rows of query terms up to which they are broadcast.
QUERY_ROWS = 200_000


@dataclass
class Index:
    """postings(term, doc, tf), lengths(doc, len), terms(term, df)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, key: str, terms: Column) -> Index:
        docs = rows.select(F.col(key).alias("doc"), terms.alias("_ls_terms"))
        postings = histogram(docs, "doc", F.col("_ls_terms"))
        lengths = docs.select("doc", F.size("_ls_terms").cast("long").alias("len")).where("len > 0")
        return cls(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")))

    def write(self, path: str) -> None:
        for name in ("postings", "lengths", "terms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def saved(self) -> Index:
        """Written once into shared scratch storage, so that searches read it instead of making it anew."""
        return Index(save(self.postings, "postings"), save(self.lengths, "lengths"), save(self.terms, "terms"))

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms")))


def without(rows: DataFrame, excluded: DataFrame, key: str, name: str | None = None, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Rows to index, minus excluded keys, and minus those whose ``name`` ends with one of the suffixes."""
    kept = rows.join(excluded.select(key).distinct(), key, "left_anti")
    return kept.where(~ends_with_any(F.col(name), list(suffixes))) if name and suffixes else kept


def score(index: Index, queries: DataFrame) -> DataFrame:
    """``(query, doc, score)`` of all matching documents; ``queries(query, term, qtf)``.

    Postings are cut to the queries' terms by a broadcast of these terms (if they are counted to be few) before anything
    is shuffled, so only matching postings move.
    """
    fit = _few(queries)
    return _scored(index.postings, index.lengths, _weighed(index, queries, fit), fit)


def _few(queries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks frames of the size of ``queries`` for broadcast, if these are counted to be few."""
    return F.broadcast if queries.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS else lambda df: df


def _weighed(index: Index, queries: DataFrame, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``queries`` with each term's ``idf`` in the index and each query's ``clauses``."""
    n = index.lengths.agg(F.count("*").alias("n_docs"))
    wanted = queries.select("term").distinct()
    idf = index.postings.join(fit(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = idf.join(F.broadcast(n)).select("term", (1 + F.log(F.col("n_docs") / (F.col("df") + 1))).alias("idf"))
    clauses = queries.groupBy("query").agg(F.sum("qtf").alias("clauses"))
    return queries.join(idf, "term").join(clauses, "query")


def _scored(postings: DataFrame, lengths: DataFrame, weighed: DataFrame, fit: Callable[[DataFrame], DataFrame], *more: str) -> DataFrame:
    """``(query, doc, score)`` and the columns ``more`` of ``lengths``."""
    hits = postings.join(fit(weighed), "term")
    gain = F.col("qtf") * F.sqrt("tf") * F.col("idf") * F.col("idf")
    sums = hits.groupBy("query", "doc").agg(F.sum(gain).alias("gain"), F.sum("qtf").alias("met"), F.max("clauses").alias("clauses"))
    out = sums.join(lengths, "doc")
    return out.select("query", "doc", F.round(F.col("met") / F.col("clauses") * F.col("gain") / F.sqrt("len"), 6).alias("score"), *more)


def top(scores: DataFrame, n: int | None) -> DataFrame:
    """``(query, doc, score, rank)`` of the first n results of each query (all if n is None)."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def search(index: Index, queries: DataFrame, n: int | None = 20) -> DataFrame:
    return top(score(index, queries), n)


def _alike(rows: DataFrame, key: str, count: str) -> DataFrame:
    """``(key, terms, n1, n2)``: each key's sorted terms with their counts, and their 128-bit name."""
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", count))).alias("terms"))
    return out.withColumns({"n1": F.xxhash64("terms"), "n2": F.xxhash64(F.lit(1), "terms")})


def search_alike(index: Index, queries: DataFrame, n: int) -> DataFrame:
    """``search`` for many queries: documents, and queries, with the same terms as often are scored as one.

    A class's documents have one score, so the first n of a query are among the n smallest documents of the first n
    classes, in order of the score and the class's smallest document. Pairs of classes are made, not pairs of documents.
    """
    docs = _alike(index.postings, "doc", "tf").join(index.lengths, "doc")
    docs = save(docs.withColumns({"n1": F.xxhash64("n1", "len"), "n2": F.xxhash64("n2", "len")}), "alike")
    order = Window.partitionBy("n1", "n2").orderBy("doc")
    firsts = docs.select("n1", "n2", "doc").withColumn("_ls_n", F.row_number().over(order)).where(F.col("_ls_n") <= n)
    firsts = save(firsts.select(F.struct("n1", "n2").alias("class"), "doc"), "firsts")
    kinds = docs.groupBy("n1", "n2").agg(F.first("terms").alias("terms"), F.first("len").alias("len"), F.min("doc").alias("low"))
    kinds = save(kinds.select(F.struct("n1", "n2").alias("doc"), "terms", "len", "low"), "kinds")
    asked = save(_alike(queries, "query", "qtf"), "alike").withColumn("kind", F.struct("n1", "n2"))
    each = asked.groupBy("n1", "n2").agg(F.first("terms").alias("terms")).select(F.struct("n1", "n2").alias("query"), F.explode("terms").alias("t"))
    each = save(each.select("query", "t.term", "t.qtf"), "asked")

    fit = _few(each)
    weighed = save(_weighed(index, each, fit), "weighed")
    postings = kinds.select("doc", F.explode("terms").alias("t")).select("doc", "t.term", "t.tf")
    pairs = _scored(postings, kinds.select("doc", "len", "low"), weighed, fit, "low")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    pairs = pairs.withColumn("_ls_n", F.row_number().over(best)).where(F.col("_ls_n") <= n)
    found = pairs.select("query", F.col("doc").alias("class"), "score").join(firsts, "class").select("query", "doc", "score")
    found = save(top(found, n), "found").withColumnRenamed("query", "kind")
    return asked.select("query", "kind").join(small(found), "kind").select("query", "doc", "score", "rank")

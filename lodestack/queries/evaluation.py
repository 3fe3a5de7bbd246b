"""Queries on the quality of result lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import tokens
from ..operators import evaluate, rank
from ..plans import pipelines
from ..storage import save, scratch_path, small
from .registry import query, table
from .retrieval import IMAGE_SEARCH, TEXT_SEARCH, _top, image_results, text_results

#: Items of at most four words that are looked up in all documents at a time.
SHORT_ITEMS = 1000

_RESULTS = f"WITH {TEXT_SEARCH}, res AS ({_top(None)}), tox AS (SELECT DISTINCT doc_id AS doc FROM labels WHERE toxic = 1)"
_CLEAN = _RESULTS + ", cln AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM res WHERE doc NOT IN (SELECT doc FROM tox))"
_GOOD = """good AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE doc_id NOT IN (SELECT doc FROM tox))"""


def holders(spark, sf_dir):
    """``(query, doc)``: documents that hold a benchmark item word for word.

    An item's inner words are whole words of a document that holds it, so candidates are joined on a run of three inner
    words. Items with fewer than three are a stated query set: they are compared with every document, in blocks.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"), tokens(F.col("text")).alias("w"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    long_ = save(items.where("size(w) >= 5").select("query", "item", F.xxhash64(F.slice("w", 2, 3)).alias("h")), "items")
    w = docs.select("doc", tokens(F.col("text")).alias("w"))
    runs = w.select("doc", F.explode(F.array_distinct(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(F.slice("w", i + 1, 3))))).alias("h"))
    near = save(runs.join(small(long_), "h").select("query", "item", "doc"), "near")
    holder = docs.join(small(near.select("doc").distinct()), "doc", "left_semi")
    found = near.join(holder, "doc").where(F.col("text").contains(F.col("item"))).select("query", "doc")
    short = save(items.where("size(w) < 5 and item <> ''").select("query", "item"), "short")
    blocks = -(-short.count() // SHORT_ITEMS)
    for b in range(blocks):
        block = short.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        found = found.unionByName(docs.join(F.broadcast(block), F.col("text").contains(F.col("item"))).select("query", "doc"))
    return found.distinct()


def judgments(spark, sf_dir, results):
    """good: the document holds the item; junk: a result that is toxic, whatever it holds."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc")).distinct()
    good = holders(spark, sf_dir).join(toxic, "doc", "left_anti").select("query", "doc", F.lit("good").alias("grade"))
    junk = results.join(toxic, "doc", "left_semi").select("query", "doc", F.lit("junk").alias("grade"))
    return good.unionByName(junk)


_AP = _CLEAN + f""", {_GOOD}, cnt AS (SELECT query, count(*) AS n FROM good GROUP BY query),
m AS (SELECT cln.query, cln.doc, cln.rank, CASE WHEN good.doc IS NULL THEN 0 ELSE 1 END AS rel FROM cln LEFT JOIN good ON good.query = cln.query AND good.doc = cln.doc),
p AS (SELECT query, rel * sum(rel) OVER (PARTITION BY query ORDER BY rank) / rank AS p FROM m),
s AS (SELECT query, sum(p) AS s FROM p GROUP BY query),
ap AS (SELECT cnt.query, n AS n_relevant, round(coalesce(s, 0) / n, 6) AS ap FROM cnt LEFT JOIN s ON s.query = cnt.query)"""


@query(_AP + " SELECT query, n_relevant, ap FROM ap")
def average_precision(spark, sf_dir):
    results = save(text_results(spark, sf_dir, None), "results")
    return evaluate.average_precision(results, judgments(spark, sf_dir, results))


@query(_AP + " SELECT count(*) AS n_queries, round(avg(ap), 6) AS map FROM ap")
def mean_average_precision(spark, sf_dir):
    results = save(text_results(spark, sf_dir, None), "results")
    return evaluate.mean_average_precision(evaluate.average_precision(results, judgments(spark, sf_dir, results)))


@query(_CLEAN + " SELECT query, doc, rank FROM cln WHERE rank <= 20")
def junk_removal(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc"))
    return rank.without_junk(text_results(spark, sf_dir, None), toxic).where("rank <= 20").select("query", "doc", "rank")


_GRADES = "gr AS (SELECT doc_id AS doc, CASE WHEN toxic = 1 THEN 'junk' WHEN quality = 1 THEN 'good' ELSE 'ok' END AS grade FROM labels)"


def grades(spark, sf_dir):
    grade = F.when(F.col("toxic") == 1, "junk").when(F.col("quality") == 1, "good").otherwise("ok")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), grade.alias("grade"))


@query(_CLEAN + f""", {_GRADES}, a AS (SELECT query, count(*) AS k, count(*) FILTER (doc IN (SELECT doc FROM gr WHERE grade <> 'junk')) AS hits FROM cln WHERE rank <= 20 GROUP BY query),
b AS (SELECT query, hits / k AS p, hits / (SELECT count(DISTINCT doc) FROM gr WHERE grade <> 'junk') AS r FROM a)
SELECT query, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1 FROM b""")
def precision_recall_f1(spark, sf_dir):
    g = grades(spark, sf_dir)
    marked = evaluate.judged_by_document(text_results(spark, sf_dir, None), g)
    counts = g.where(F.col("grade").isin(*evaluate.RELEVANT)).agg(F.countDistinct("doc").alias("n_relevant"))
    return evaluate.precision_recall_f1(marked, counts, 20)


@query(f"""WITH {IMAGE_SEARCH}, l AS (SELECT doc, label FROM (SELECT vec_id // 10 AS doc, label, count(*) AS n FROM embeddings GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, label) = 1), r AS ({_top(20)})
SELECT r.query, round(sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) / count(*), 6) AS precision_at_k
FROM r JOIN l a ON a.doc = r.doc JOIN l b ON b.doc = r.query GROUP BY ALL""")
def precision_at_k_by_label(spark, sf_dir):
    """An image's label is that of most of its vectors, the smallest of several."""
    counts = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 10").alias("doc"), "label").agg(F.count("*").alias("n"))
    labels = counts.groupBy("doc").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m")).select("doc", (-F.col("m.l")).alias("label"))
    return evaluate.precision_at_k(image_results(spark, sf_dir, 20), labels, labels.withColumnRenamed("doc", "query"), 20)


_HIT = _RESULTS + f""", {_GOOD}, ex AS (SELECT query, min(doc) AS doc FROM good GROUP BY query),
hit5 AS (SELECT ex.query, CASE WHEN ex.query % 7 = 0 THEN -1 WHEN r.doc IS NULL THEN 0 ELSE 1 END AS hit
FROM ex LEFT JOIN res r ON r.query = ex.query AND r.doc = ex.doc AND r.rank <= 5)"""


def _hits(spark, sf_dir):
    """Whether an item's first clean holder is among the first five results; every seventh item is excluded."""
    results = save(text_results(spark, sf_dir, 5), "results")
    expected = judgments(spark, sf_dir, results).where("grade = 'good'").groupBy("query").agg(F.min("doc").alias("doc"))
    return evaluate.hit_at(results, expected, 5, expected.where("query % 7 = 0"))


@query(_HIT + " SELECT query, CAST(hit AS INTEGER) AS hit FROM hit5")
def hit_at_5(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(_HIT + " SELECT count(*) AS n_queries, round(sum(hit) / count(*), 6) AS accuracy FROM hit5 WHERE hit >= 0")
def hit_accuracy(spark, sf_dir):
    return evaluate.accuracy(_hits(spark, sf_dir))


@query(f"""WITH {IMAGE_SEARCH}, r AS ({_top(20)})
SELECT query, round(sum(CASE WHEN contains(CAST(doc AS VARCHAR), CAST(query // 10 AS VARCHAR)) THEN 1 ELSE 0 END) / count(*), 6) AS precision_at_k FROM r GROUP BY query""")
def precision_at_k_by_name(spark, sf_dir):
    """A result counts if its name holds the query's class, here the query's leading digits."""
    results = save(image_results(spark, sf_dir, 20), "results")
    classes = results.select("query").distinct().withColumn("class", F.expr("query div 10").cast("string"))
    return evaluate.precision_at_k_by_name(results, classes, 20)


@query(_AP + " SELECT 'all' AS run, count(*) AS n_queries, round(avg(ap), 6) AS map FROM ap")
def map_from_saved_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    text_results(spark, sf_dir, None).write.parquet(path)
    return pipelines.saved_map(spark, {"all": path}, judgments(spark, sf_dir, spark.read.parquet(path)))

"""Queries on the inverted index: building, ranked search, fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import tokens
from ..operators import bow, rank, retrieval
from ..plans import pipelines, stored
from ..storage import save, scratch_path
from .registry import query, table
from .vectors import _E, _W, embeddings, words

_CUT = "list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')"
_TOK = f"tok AS (SELECT doc_id AS doc, unnest({_CUT}) AS term FROM documents)"


def _scores(docs: str, queries: str, p: str = "") -> str:
    """CTEs up to ``score(query, doc, score)`` from ``docs(doc, term)`` and ``queries(query, term, qtf)``; p: a name prefix."""
    return f"""
{p}post AS (SELECT doc, term, count(*) AS tf FROM {docs} GROUP BY ALL),
{p}len AS (SELECT doc, count(*) AS len FROM {docs} GROUP BY doc),
{p}idf AS (SELECT term, 1 + ln((SELECT count(*) FROM {p}len) / (count(*) + 1)) AS idf FROM {p}post GROUP BY term),
{p}cl AS (SELECT query, sum(qtf) AS clauses FROM {queries} GROUP BY query),
{p}hit AS (SELECT query, doc, sum(qtf * sqrt(tf) * idf * idf) AS gain, sum(qtf) AS met FROM {queries} JOIN {p}post USING (term) JOIN {p}idf USING (term) GROUP BY ALL),
{p}score AS (SELECT query, doc, round(met / clauses * gain / sqrt(len), 6) AS score FROM {p}hit JOIN {p}cl USING (query) JOIN {p}len USING (doc))"""


def _top(n: int | None, score: str = "score") -> str:
    cut = "" if n is None else f" QUALIFY rank <= {n}"
    return f"SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {score}{cut}"


TEXT_SEARCH = f"""{_TOK}, q AS (SELECT item_id AS query, term, count(*) AS qtf FROM (SELECT item_id, unnest({_CUT}) AS term FROM benchmark) GROUP BY ALL),
{_scores("tok", "q")}"""
IMAGE_SEARCH = f"""{_W}, vis AS (SELECT vec_id // 10 AS doc, CAST(cid AS VARCHAR) AS term FROM w),
vq AS (SELECT doc AS query, term, count(*) AS qtf FROM vis WHERE doc % 10 = 0 GROUP BY ALL),
{_scores("vis", "vq")}"""


def text_index(spark, sf_dir):
    return retrieval.Index.build(table(spark, sf_dir, "documents"), "doc_id", tokens(F.col("text")))


def benchmark_terms(spark, sf_dir):
    return bow.histogram(table(spark, sf_dir, "benchmark"), "item_id", tokens(F.col("text"))).select(F.col("item_id").alias("query"), "term", F.col("tf").alias("qtf"))


def text_results(spark, sf_dir, n):
    """Ranked documents for every benchmark item; all of them if n is None."""
    return retrieval.search(text_index(spark, sf_dir).saved(), benchmark_terms(spark, sf_dir), n)


def image_histogram(spark, sf_dir):
    """``(image_id, term, tf)`` of visual words."""
    return words(spark, sf_dir).where("word is not null").groupBy("image_id", F.col("word").cast("string").alias("term")).agg(F.count("*").alias("tf"))


def image_results(spark, sf_dir, n):
    """Ranked images for every tenth image."""
    postings = save(image_histogram(spark, sf_dir).withColumnRenamed("image_id", "doc"), "postings")
    lengths = postings.groupBy("doc").agg(F.sum("tf").alias("len"))
    index = retrieval.Index(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")))
    return retrieval.search(index, postings.where("doc % 10 = 0").select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf")), n)


@query(f"WITH {_TOK} SELECT term, doc AS doc_id, count(*) AS tf FROM tok GROUP BY ALL")
def inverted_index(spark, sf_dir):
    return text_index(spark, sf_dir).postings.select("term", F.col("doc").alias("doc_id"), "tf")


@query(f"WITH {_TOK} SELECT term, count(DISTINCT doc) AS df FROM tok GROUP BY term")
def document_frequency(spark, sf_dir):
    return text_index(spark, sf_dir).terms


@query(f"SELECT doc_id, CAST(len({_CUT}) AS BIGINT) AS n_tokens FROM documents")
def tokenize_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {TEXT_SEARCH} {_top(10)}")
def tfidf_search_topk(spark, sf_dir):
    return text_results(spark, sf_dir, 10)


@query(f"WITH {IMAGE_SEARCH} {_top(20)}")
def topk_per_query(spark, sf_dir):
    return image_results(spark, sf_dir, 20)


@query(f"""WITH {TEXT_SEARCH}, x AS (SELECT doc_id FROM labels WHERE toxic = 1), s AS (SELECT * FROM score WHERE doc NOT IN (SELECT doc_id FROM x))
{_top(10, "s")}""")
def filtered_search_topk(spark, sf_dir):
    """Search with a filter on the documents, the ranking statistics unchanged."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc")).distinct()
    scores = retrieval.score(text_index(spark, sf_dir).saved(), benchmark_terms(spark, sf_dir))
    return retrieval.top(scores.join(toxic, "doc", "left_anti"), 10)


@query(f"""WITH {_W}, t AS (SELECT doc_id, {_CUT} AS t FROM documents),
v AS (SELECT vec_id // 10 AS image_id, list('vw' || cid ORDER BY cid) AS v FROM w GROUP BY 1)
SELECT image_id, CAST(len(v) + len(t) AS BIGINT) AS n_terms, array_to_string(list_concat(v, t), ' ') AS terms FROM v JOIN t ON t.doc_id = v.image_id""")
def multimodal_terms(spark, sf_dir):
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "text")
    return bow.multimodal(bow.frequency(words(spark, sf_dir), "image_id"), text, "image_id")


@query(f"""WITH {_W}, v AS (SELECT vec_id // 10 AS image_id, count(*) AS n_words, string_agg(CAST(cid AS VARCHAR), ' ' ORDER BY cid) AS words FROM w GROUP BY 1)
SELECT image_id, n_words, words, lang, source, n_chars FROM v JOIN documents ON doc_id = image_id""")
def freq_text_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "lang", "source", "n_chars")
    return bow.frequency(words(spark, sf_dir), "image_id").join(docs, "image_id")


_TWO = f"""{IMAGE_SEARCH}, img AS (SELECT DISTINCT doc FROM vis),
td AS (SELECT doc_id AS doc, unnest({_CUT}) AS term FROM documents WHERE doc_id IN (SELECT doc FROM img)),
tq AS (SELECT doc AS query, term, count(*) AS qtf FROM td WHERE doc % 10 = 0 GROUP BY ALL),
{_scores("td", "tq", "t")},
a AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS ra FROM tscore),
b AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS rb FROM score),
f AS (SELECT query, doc, ra, rb, count(ra) OVER (PARTITION BY query) AS na, count(rb) OVER (PARTITION BY query) AS nb FROM a FULL JOIN b USING (query, doc)),
g AS (SELECT query, doc,
  round(0.6::DOUBLE * coalesce(ra, na + row_number() OVER (PARTITION BY query, ra IS NULL ORDER BY rb) - 1)
      + (1 - 0.6::DOUBLE) * coalesce(rb, nb + row_number() OVER (PARTITION BY query, rb IS NULL ORDER BY ra) - 1), 6) AS fused FROM f)"""


@query(f"WITH {_TWO} SELECT query, doc, fused, row_number() OVER (PARTITION BY query ORDER BY fused, doc) AS rank FROM g")
def rank_fusion(spark, sf_dir):
    """Text ranking and visual ranking of every tenth image's neighbours, fused over their whole lengths."""
    visual = image_results(spark, sf_dir, None)
    images = image_histogram(spark, sf_dir).select(F.col("image_id").alias("doc_id")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(images, "doc_id", "left_semi")
    index = retrieval.Index.build(docs, "doc_id", tokens(F.col("text"))).saved()
    asked = index.postings.where("doc % 10 = 0").select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf"))
    return rank.fuse(retrieval.search(index, asked, None), visual, 0.6)


_H = f"""{IMAGE_SEARCH}, r AS ({_top(20)}), h AS (SELECT doc, term, count(*) AS tf FROM vis GROUP BY ALL),
n AS (SELECT doc, sum(tf) AS l1, sqrt(sum(tf * tf)) AS l2 FROM h GROUP BY doc)"""


@query(f"""WITH {_H}, d AS (SELECT r.query, r.doc, r.rank, -coalesce(sum(a.tf * b.tf), 0) / (any_value(x.l2) * any_value(y.l2)) AS dist
  FROM r JOIN n x ON x.doc = r.query JOIN n y ON y.doc = r.doc LEFT JOIN h a ON a.doc = r.query LEFT JOIN h b ON b.doc = r.doc AND b.term = a.term GROUP BY ALL),
s AS (SELECT query, doc, rank AS old, round(dist, 6) AS dist FROM d)
SELECT query, doc, old, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN old <= 5 THEN 0 ELSE 1 END, CASE WHEN old <= 5 THEN dist END NULLS LAST, old) AS rank FROM s""")
def rerank_prefix(spark, sf_dir):
    results = image_results(spark, sf_dir, 20)
    h = image_histogram(spark, sf_dir)
    head = results.where("rank <= 5").select("query", "doc")
    distances = rank.histogram_distance(head, h.withColumnRenamed("image_id", "query"), h.withColumnRenamed("image_id", "doc"))
    return rank.rerank_prefix(results, distances, 5)


@query(f"""WITH {_H}, p AS (SELECT query, doc FROM r),
t AS (SELECT DISTINCT p.query, p.doc, h.term FROM p JOIN h ON h.doc = p.query OR h.doc = p.doc),
v AS (SELECT t.query, t.doc, coalesce(a.tf, 0) / x.l1 AS x1, coalesce(b.tf, 0) / y.l1 AS y1, coalesce(a.tf, 0) / x.l2 AS x2, coalesce(b.tf, 0) / y.l2 AS y2
  FROM t JOIN n x ON x.doc = t.query JOIN n y ON y.doc = t.doc LEFT JOIN h a ON a.doc = t.query AND a.term = t.term LEFT JOIN h b ON b.doc = t.doc AND b.term = t.term)
SELECT query, doc, round(sum(abs(x1 - y1)), 6) AS l1, round(sqrt(sum((x2 - y2) ** 2)), 6) AS l2, round(-sum(x2 * y2), 6) AS cosine FROM v GROUP BY ALL""")
def histogram_similarity(spark, sf_dir):
    pairs = image_results(spark, sf_dir, 20).select("query", "doc")
    h = image_histogram(spark, sf_dir)
    a, b = h.withColumnRenamed("image_id", "query"), h.withColumnRenamed("image_id", "doc")
    one = lambda s, n, c: rank.histogram_distance(pairs, a, b, s, n).withColumnRenamed("distance", c)
    return one("l1", "l1", "l1").join(one("l2", "l2", "l2"), ["query", "doc"]).join(one("cosine", "raw", "cosine"), ["query", "doc"])


@query(f"""WITH {_W}, v AS (SELECT vec_id // 10 AS image_id, 'vw' || cid AS t, cid AS o FROM w),
t AS (SELECT doc_id AS image_id, unnest({_CUT}) AS t, 1000 + generate_subscripts({_CUT}, 1) AS o FROM documents),
b AS (SELECT 0 AS modality, * FROM v WHERE image_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 0, * FROM t WHERE image_id IN (SELECT image_id FROM v)
  UNION ALL SELECT 1, * FROM v UNION ALL SELECT 2, * FROM t)
SELECT modality, image_id, count(*) AS n_terms, md5(string_agg(t, ' ' ORDER BY o)) AS terms FROM b GROUP BY ALL""")
def modality_switch(spark, sf_dir):
    """Terms from both kinds of words (0), from visual words (1), from text (2)."""
    freq = save(bow.frequency(words(spark, sf_dir), "image_id"), "frequency")
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "text")
    out = None
    for m in (pipelines.BOTH, pipelines.VISUAL, pipelines.TEXT):
        one = pipelines.terms(freq, text, "image_id", m).select(F.lit(m).alias("modality"), "image_id", "n_terms", F.md5("terms").alias("terms")).where("n_terms > 0")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_E}, k AS (SELECT vec_id // 10 AS image_id, vec_id, e FROM e),
c0 AS (SELECT vec_id AS cid, e AS c FROM e WHERE vec_id < 4),
w0 AS (SELECT vec_id, e.e, cid FROM e, c0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(e.e, c) DESC, cid) = 1),
m0 AS (SELECT cid, i, avg(v) AS m FROM (SELECT cid, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM w0) GROUP BY ALL),
c1 AS (SELECT c0.cid, coalesce(list(m ORDER BY i) FILTER (m IS NOT NULL), any_value(c)) AS c FROM c0 LEFT JOIN m0 USING (cid) GROUP BY c0.cid),
vis AS (SELECT image_id AS doc, CAST(cid AS VARCHAR) AS term FROM k, c1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(e, c) DESC, cid) = 1),
vq AS (SELECT doc AS query, term, count(*) AS qtf FROM vis GROUP BY ALL), {_scores("vis", "vq")}
{_top(5)}""")
def stored_model_search(spark, sf_dir):
    """A vocabulary of one iteration and its index, written, read again, and searched with every image."""
    path, features = scratch_path(spark, "model"), embeddings(spark, sf_dir)
    config = pipelines.Config("kmeans", 4, 1, iterations=1, delta=0.0)
    stored.Engine.build(features, config, "image_id", "vec_id").write(spark, path)
    return stored.Engine.read(spark, path).search(features, "image_id", 5)

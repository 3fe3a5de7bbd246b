"""Queries on vectors: distances, nearest centroids, k-means, approximate search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ann, assign, bow, cluster
from ..sources import files, sinks
from ..storage import scratch_path
from .registry import query, table

K, TOP_K, BOT_K = 16, 4, 4

_C = "c AS (SELECT vec_id AS cid, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 16)"
_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
#: Nearest of 16 centroids by cosine; ties to the smallest id.
_W = f"""{_C}, {_E},
w AS (SELECT vec_id, e, cid, list_cosine_similarity(e, c) AS sim FROM e, c
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cid) = 1)"""


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("image_id", F.expr("vec_id div 10"))


def centroids(spark, sf_dir, k=K):
    return embeddings(spark, sf_dir).where(F.col("vec_id") < k).select(F.col("vec_id").alias("cid"), F.col("embedding").alias("centroid"))


def words(spark, sf_dir, k=K):
    """Every descriptor with its nearest word."""
    return assign.assign(embeddings(spark, sf_dir), assign.Vocabulary.collect(centroids(spark, sf_dir, k))).withColumnRenamed("cid", "word")


@query(f"WITH {_W} SELECT vec_id, cid, round(sim, 6) AS similarity FROM w")
def nearest_centroid_cosine(spark, sf_dir):
    found = assign.assign(embeddings(spark, sf_dir), assign.Vocabulary.collect(centroids(spark, sf_dir)))
    return found.select("vec_id", "cid", F.round("value", 6).alias("similarity"))


@query(f"""WITH {_C}, {_E}
SELECT vec_id, cid, round(list_distance(e, c), 6) AS distance FROM e, c
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, c), cid) = 1""")
def nearest_centroid_l2(spark, sf_dir):
    found = assign.assign(embeddings(spark, sf_dir), assign.Vocabulary.collect(centroids(spark, sf_dir), "euclidean"))
    return found.select("vec_id", "cid", F.round("value", 6).alias("distance"))


_H = f"""WITH {_E}, t AS (
  SELECT a.vec_id, a.e, b.vec_id AS top_id FROM e a, e b WHERE b.vec_id < 4
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) = 1),
s AS (SELECT top_id, e AS c, row_number() OVER (PARTITION BY top_id ORDER BY vec_id) - 1 AS bot_id FROM t
      QUALIFY row_number() OVER (PARTITION BY top_id ORDER BY vec_id) <= 4),
h AS (SELECT t.vec_id, t.top_id, bot_id, t.top_id * 4 + bot_id AS word FROM t JOIN s USING (top_id)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(e, c) DESC, bot_id) = 1)"""


def _hierarchical(spark, sf_dir):
    """Two-level words: bottom seeds are the first members of each top word."""
    df = embeddings(spark, sf_dir)
    top = assign.Vocabulary.collect(centroids(spark, sf_dir, TOP_K))
    split = assign.assign(df.select("vec_id", "embedding"), top).withColumnRenamed("cid", "top_id")
    seeds = cluster.bottom_seeds(split, BOT_K, "vec_id")
    bottoms = {t: assign.Vocabulary(np.arange(len(v)), np.array(v)) for t, v in seeds.items()}
    return assign.assign_two_level(df, top, bottoms, BOT_K)


@query(_H + " SELECT vec_id, top_id, bot_id, word FROM h")
def hierarchical_assign(spark, sf_dir):
    return _hierarchical(spark, sf_dir).select("vec_id", "top_id", "bot_id", "word")


@query(_H + " SELECT vec_id // 10 AS image_id, count(*) AS n_words, string_agg(CAST(word AS VARCHAR), ' ' ORDER BY word) AS words FROM h GROUP BY 1")
def bow_frequency_two_level(spark, sf_dir):
    return bow.frequency(_hierarchical(spark, sf_dir), "image_id")


@query(f"WITH {_W} SELECT vec_id // 10 AS image_id, count(*) AS n_words, string_agg(CAST(cid AS VARCHAR), ' ' ORDER BY cid) AS words FROM w GROUP BY 1")
def bow_frequency(spark, sf_dir):
    return bow.frequency(words(spark, sf_dir), "image_id")


@query(f"WITH {_W} SELECT vec_id // 10 AS image_id, cid AS word, count(*) AS tf FROM w WHERE vec_id // 10 % 10 = 0 GROUP BY ALL")
def query_histogram(spark, sf_dir):
    return words(spark, sf_dir).where("image_id % 10 = 0").groupBy("image_id", "word").agg(F.count("*").alias("tf"))


def _long(rows, value="mean"):
    return rows.select("cid", F.posexplode(value).alias("i", "v")).select("cid", F.col("i").cast("int").alias("i"), F.round("v", 6).alias("value"))


def _start(spark, sf_dir, metric="cosine"):
    return {0: assign.Vocabulary.collect(centroids(spark, sf_dir), metric)}


def _vectors(spark, sf_dir):
    return embeddings(spark, sf_dir).select("embedding", F.lit(0).cast("long").alias("_ls_top"))


@query(f"""WITH {_W}, x AS (SELECT cid, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i FROM w)
SELECT cid, CAST(i AS INTEGER) AS i, round(avg(v), 6) AS value FROM x GROUP BY ALL""")
def kmeans_one_iteration(spark, sf_dir):
    return _long(cluster.sums(_vectors(spark, sf_dir), _start(spark, sf_dir)))


@query(f"""WITH {_W}, x AS (SELECT cid, vec_id, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM w),
m AS (SELECT cid, i, avg(v) AS m FROM x GROUP BY ALL)
SELECT cid, count(DISTINCT vec_id) AS n, round(sum((v - m) ** 2), 6) AS rss FROM x JOIN m USING (cid, i) GROUP BY cid""")
def kmeans_rss(spark, sf_dir):
    return cluster.sums(_vectors(spark, sf_dir), _start(spark, sf_dir)).select("cid", "n", F.round("rss", 6).alias("rss"))


def _iterations(n: int, start: str, rows: str, p: str = "") -> str:
    """CTEs of n iterations from ``start(top, cid, c)`` over ``rows(top, vec_id, e)``; the last is ``{p}c{n}``."""
    out, last = [], start
    for i in range(1, n + 1):
        out.append(f"""{p}w{i} AS (SELECT r.top, r.vec_id, r.e, s.cid FROM {rows} r JOIN {last} s ON s.top = r.top
  QUALIFY row_number() OVER (PARTITION BY r.vec_id ORDER BY list_cosine_similarity(r.e, s.c) DESC, s.cid) = 1),
{p}m{i} AS (SELECT top, cid, i, avg(v) AS m FROM (SELECT top, cid, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM {p}w{i}) GROUP BY ALL),
{p}n{i} AS (SELECT top, cid, list(m ORDER BY i) AS c FROM {p}m{i} GROUP BY ALL),
{p}c{i} AS (SELECT s.top, s.cid, coalesce(n.c, s.c) AS c FROM {last} s LEFT JOIN {p}n{i} n ON n.top = s.top AND n.cid = s.cid)""")
        last = f"{p}c{i}"
    return ",\n".join(out)


ITERATIONS = 5


@query(f"""WITH {_E}, z AS (SELECT 0 AS top, vec_id, e FROM e), s AS (SELECT 0 AS top, vec_id AS cid, e AS c FROM e WHERE vec_id < 16),
{_iterations(ITERATIONS, "s", "z")}
SELECT cid, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS i, round(unnest(c), 6) AS value FROM c{ITERATIONS}""")
def kmeans_fixed_iterations(spark, sf_dir):
    found = cluster.lloyd(_vectors(spark, sf_dir), _start(spark, sf_dir), iterations=ITERATIONS, delta=0.0).vocabularies[0]
    return _long(_rows(spark, found))


def _rows(spark, v):
    return spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(v.ids, v.matrix)], "cid long, mean array<double>")


@query(f"""WITH {_E}, o AS (SELECT vec_id AS cid, e AS c FROM e WHERE vec_id < 8 UNION ALL SELECT 8, list_transform(e, lambda x: 0::DOUBLE) FROM e WHERE vec_id = 0),
w AS (SELECT vec_id, e, cid FROM e, o WHERE cid < 8 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(e, c) DESC, cid) = 1),
x AS (SELECT cid, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i FROM w),
y AS (SELECT cid, unnest(c) AS v, generate_subscripts(c, 1) - 1 AS i FROM o),
m AS (SELECT cid, i, avg(v) AS v FROM x GROUP BY ALL)
SELECT y.cid, CAST(y.i AS INTEGER) AS i, round(coalesce(m.v, y.v), 6) AS value FROM y LEFT JOIN m ON m.cid = y.cid AND m.i = y.i""")
def empty_cluster_carryover(spark, sf_dir):
    zero = embeddings(spark, sf_dir).where("vec_id = 0").select(F.lit(8).cast("long").alias("cid"), F.transform("embedding", lambda x: F.lit(0.0)).alias("centroid"))
    old = centroids(spark, sf_dir, 8).withColumn("centroid", F.col("centroid").cast("array<double>")).unionByName(zero)
    new = cluster.sums(_vectors(spark, sf_dir), {0: assign.Vocabulary.collect(old)}).select("cid", F.col("mean").alias("centroid"))
    return _long(cluster.carry_over(old, new), "centroid")


@query(f"""WITH {_W}, x AS (SELECT cid, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM w), m AS (SELECT cid, i, avg(v) AS m FROM x GROUP BY ALL),
n AS (SELECT cid, list(m ORDER BY i) AS m FROM m GROUP BY cid), d AS (SELECT list_distance(m, c) AS moved FROM n JOIN c USING (cid))
SELECT round(max(moved), 6) AS moved, max(moved) <= 0.001 AS converged FROM d""")
def kmeans_convergence(spark, sf_dir):
    new = cluster.sums(_vectors(spark, sf_dir), _start(spark, sf_dir)).join(F.broadcast(centroids(spark, sf_dir)), "cid")
    moved = V.euclidean_distance(F.col("mean"), F.col("centroid"))
    return new.agg(F.max(moved).alias("m")).select(F.round("m", 6).alias("moved"), (F.col("m") <= cluster.DELTA).alias("converged"))


@query(f"""WITH {_E} SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(list_distance(a.e, b.e), 6) AS l2,
  round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS l1
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vector_distances(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    x, y = F.col("a"), F.col("b")
    both = a.join(b, "vec_id")
    return both.select(
        "vec_id", F.round(V.cosine_similarity(x, y), 6).alias("cosine"), F.round(V.euclidean_distance(x, y), 6).alias("l2"), F.round(V.manhattan_distance(x, y), 6).alias("l1")
    )


@query(f"""WITH {_E}, s AS (SELECT vec_id, list_transform(e, lambda x: x * (vec_id % 7 + 1)) AS v FROM e),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM s)
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i, round(unnest(v), 6) AS value FROM n""")
def l2_normalize(spark, sf_dir):
    scaled = embeddings(spark, sf_dir).withColumn("v", F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("vec_id") % 7 + 1)))
    return scaled.select("vec_id", F.posexplode(V.l2_normalize(F.col("v"))).alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("value"))


@query(f"""WITH {_E}, m AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM e)
SELECT vec_id, string_agg(CAST(CAST(trunc(127 * x / m) AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS bytes
FROM (SELECT vec_id, m, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM m) GROUP BY vec_id""")
def quantize_bytes(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.array_join(V.quantize_bytes(F.col("embedding")).cast("array<string>"), ",").alias("bytes"))


_X = f"WITH {_E}, x AS (SELECT vec_id, unnest(e) AS v, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS i FROM e)"


def _cells(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "v"))


@query(_X + " SELECT i, round(var_pop(v) * count(*), 6) AS variance FROM x GROUP BY i ORDER BY variance DESC, i LIMIT 5")
def dimension_variance_topk(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("i").agg(F.round(F.var_pop("v") * F.count("*"), 6).alias("variance")).orderBy(F.desc("variance"), "i").limit(5)


@query(_X + """, m AS (SELECT i, quantile_cont(v, 0.5) AS m FROM x GROUP BY i)
SELECT i, round(m, 6) AS median, count(*) FILTER (v <= m) AS n_left, count(*) FILTER (v > m) AS n_right FROM x JOIN m USING (i) GROUP BY ALL""")
def median_split(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    medians = cells.groupBy("i").agg(F.percentile("v", 0.5).alias("m"))
    both = cells.join(F.broadcast(medians), "i")
    return both.groupBy("i", "m").agg(F.count(F.when(F.col("v") <= F.col("m"), 1)).alias("n_left"), F.count(F.when(F.col("v") > F.col("m"), 1)).alias("n_right")).select(
        "i", F.round("m", 6).alias("median"), "n_left", "n_right"
    )


_Q = "list_transform({v}, lambda x: trunc(127 * x / list_max(list_transform({v}, lambda y: abs(y)))))"


@query(f"""WITH q AS (SELECT vec_id, {_Q.format(v="embedding::DOUBLE[]")} AS e FROM embeddings), c AS (SELECT vec_id AS cid, e AS c FROM q WHERE vec_id < 16)
SELECT vec_id, cid, round(list_distance(e, c), 6) AS distance FROM q, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, c), cid) = 1""")
def nearest_centroid_bytes(spark, sf_dir):
    """Nearest centroid of byte vectors: an eighth of the memory of doubles."""
    df = embeddings(spark, sf_dir).select("vec_id", V.quantize_bytes(F.col("embedding")).alias("b"))
    c = df.where(F.col("vec_id") < K).select(F.col("vec_id").alias("cid"), F.col("b").alias("centroid"))
    return assign.assign(df, assign.Vocabulary.collect(c, "euclidean"), "b").select("vec_id", "cid", F.round("value", 6).alias("distance"))


@query(f"WITH {_W} SELECT cid AS word, count(*) AS n_vectors, min(vec_id) AS first_vec FROM w GROUP BY cid")
def partition_counts(spark, sf_dir):
    return words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n_vectors"), F.min("vec_id").alias("first_vec"))


@query(f"""WITH {_C} SELECT cid, CAST(i AS INTEGER) AS i, round(v, 6) AS value FROM (
  SELECT cid, unnest(c) AS v, generate_subscripts(c, 1) - 1 AS i FROM c)""")
def centroid_text_round_trip(spark, sf_dir):
    """Centroids to their text form, dense for even ids and sparse for odd ones, and back."""
    path = scratch_path(spark, "centroids")
    c = centroids(spark, sf_dir).withColumn("centroid", V.doubles(F.col("centroid")))
    dim = c.agg(F.max(F.size("centroid"))).first()[0]
    sparse = F.array_join(F.transform("centroid", lambda x, i: F.concat_ws(":", i.cast("string"), x.cast("string"))), ",")
    odd = c.where("cid % 2 = 1").select(F.concat(F.col("cid").cast("string"), F.lit("\t{"), sparse, F.lit("}")).alias("value"))
    sinks.centroid_lines(c.where("cid % 2 = 0")).unionByName(odd).write.text(path)
    return _long(files.checked_centroids(files.centroids(spark, path, dim), K), "centroid")


_FIXED = 3


@query(f"""WITH {_E}, z AS (SELECT 0 AS top, vec_id, e FROM e), s AS (SELECT 0 AS top, vec_id AS cid, e AS c FROM e WHERE vec_id < {TOP_K}),
{_iterations(_FIXED, "s", "z", "t")},
b AS (SELECT z.vec_id, z.e, s.cid AS top FROM z, tc{_FIXED} s QUALIFY row_number() OVER (PARTITION BY z.vec_id ORDER BY list_cosine_similarity(z.e, s.c) DESC, s.cid) = 1),
bs AS (SELECT top, row_number() OVER (PARTITION BY top ORDER BY vec_id) - 1 AS cid, e AS c FROM b QUALIFY row_number() OVER (PARTITION BY top ORDER BY vec_id) <= {BOT_K}),
{_iterations(_FIXED, "bs", "b", "b")}
SELECT top * {BOT_K} + cid AS cid, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS i, round(unnest(c), 6) AS value FROM bc{_FIXED}""")
def hierarchical_kmeans(spark, sf_dir):
    """Two-level vocabulary of a fixed number of iterations on either level."""
    top, bottoms = cluster.hierarchical(embeddings(spark, sf_dir), TOP_K, BOT_K, "vec_id", iterations=_FIXED, delta=0.0)
    return _long(_rows(spark, cluster.merged(top, bottoms, BOT_K)))


@query(_H + " SELECT vec_id, top_id, bot_id, word FROM h")
def hierarchical_assign_by_top_word(spark, sf_dir):
    """The two-level join with the bottom vocabularies as a table, for models beyond a task's bound."""
    df = embeddings(spark, sf_dir)
    top = assign.Vocabulary.collect(centroids(spark, sf_dir, TOP_K))
    split = assign.assign(df.select("vec_id", "embedding"), top).withColumnRenamed("cid", "top_id")
    seeds = cluster.bottom_seeds(split, BOT_K, "vec_id")
    bottoms = cluster.bottom_table(spark, {t: assign.Vocabulary(np.arange(len(v)), np.array(v)) for t, v in seeds.items()})
    return assign.assign_two_level(df, top, bottoms, BOT_K).select("vec_id", "top_id", "bot_id", "word")


def _mean_similarity(df):
    """Mean cosine of vectors ``e`` and their centroids ``c``."""
    return df.agg(F.avg(V.cosine_similarity(F.col("e"), F.col("c"))).alias("s")).first()["s"]


@query("SELECT count(*) AS n_vectors, TRUE AS as_good FROM embeddings")
def kmeans_mllib(spark, sf_dir):
    """The library's own k-means against ours: as near to its centroids, within a twentieth, over all vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = embeddings(spark, sf_dir).select("vec_id", "embedding", array_to_vector(V.doubles(F.col("embedding"))).alias("features"))
    model = KMeans(k=K, maxIter=20, tol=1e-3, seed=7, distanceMeasure="cosine").fit(df)
    theirs = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "prediction int, c array<double>")
    other = _mean_similarity(model.transform(df).join(F.broadcast(theirs), "prediction").select(V.doubles(F.col("embedding")).alias("e"), "c"))
    found = cluster.kmeans(df, centroids(spark, sf_dir)).vocabularies[0]
    own = assign.assign(df, found)
    return own.agg(F.count("cid").alias("n_vectors"), (F.avg("value") >= F.lit(0.95 * other)).alias("as_good"))


@query("SELECT count(*) AS n_vectors, TRUE AS half_exact, TRUE AS near FROM embeddings")
def akm_forest_assign(spark, sf_dir):
    """The forest with its standing share of comparisons against the exact join over all vectors: half of them or more get
    their exact nearest of 200 centroids, and the distances are within a twentieth of the exact ones in sum."""
    found = assign.Vocabulary.collect(centroids(spark, sf_dir, 200), "euclidean")
    near = ann.forest_assign(embeddings(spark, sf_dir), found).select("vec_id", F.col("cid").alias("near"), "embedding")
    c = centroids(spark, sf_dir, 200).select(F.col("cid").alias("near"), "centroid")  # 200 rows
    near = near.join(F.broadcast(c), "near").select("vec_id", "near", V.euclidean_distance(V.doubles(F.col("embedding")), V.doubles(F.col("centroid"))).alias("far"))
    exact = assign.assign(embeddings(spark, sf_dir), found).select("vec_id", "cid", "value")
    hit = F.avg((F.col("near") == F.col("cid")).cast("double"))
    return near.join(exact, "vec_id").agg(F.count("near").alias("n_vectors"), (hit >= 0.5).alias("half_exact"), (F.sum("far") <= 1.05 * F.sum("value")).alias("near"))


def _akm_as_good(df, seeds, whole=False):
    """Words, vectors, and whether the approximate vocabulary is within a twentieth of the exact one's residual sum."""
    near = ann.approximate_kmeans(df, seeds, whole=whole).vocabularies[0]
    exact = cluster.kmeans(df, seeds, "euclidean").vocabularies[0]
    rss = [assign.assign(df, v).agg(F.sum(F.col("value") * F.col("value")).alias("s"), F.count("cid").alias("n")).first() for v in (near, exact)]
    return df.sparkSession.createDataFrame([(len(near.ids), rss[0].n, rss[0].s <= 1.05 * rss[1].s)], "n_words long, n_vectors long, as_good boolean")


@query("SELECT 32::BIGINT AS n_words, count(*) AS n_vectors, TRUE AS as_good FROM embeddings")
def akm_vocabulary(spark, sf_dir):
    return _akm_as_good(embeddings(spark, sf_dir), centroids(spark, sf_dir, 32))


@query("SELECT 32::BIGINT AS n_words, count(*) AS n_vectors, TRUE AS as_good FROM embeddings")
def akm_vocabulary_bytes(spark, sf_dir):
    """Approximate k-means over byte vectors, with centroids of whole numbers."""
    df = embeddings(spark, sf_dir).select("vec_id", V.quantize_bytes(F.col("embedding")).alias("embedding"))
    seeds = df.where("vec_id < 32").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("centroid"))
    return _akm_as_good(df, seeds, True)


@query(f"""WITH {_C}, {_E}, p AS (SELECT vec_id, cid FROM e, c WHERE list_distance(e, c) < 1.2)
SELECT count(*) AS n_pairs, TRUE AS enough, 0::BIGINT AS n_wrong FROM p""")
def lsh_join(spark, sf_dir):
    """Vectors and centroids nearer than 1.2: the exact join's pairs, whether locality-sensitive hashing finds nine in ten of
    them, and how many it finds beside them."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    vector = lambda df, key, v: df.select(key, V.doubles(F.col(v)).alias("x"), array_to_vector(V.doubles(F.col(v))).alias("features"))
    df, c = vector(embeddings(spark, sf_dir), "vec_id", "embedding"), vector(centroids(spark, sf_dir), "cid", "centroid")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=4.0, numHashTables=4, seed=7).fit(df)
    near = model.approxSimilarityJoin(df, c, 1.2, "distance").select(F.col("datasetA.vec_id").alias("vec_id"), F.col("datasetB.cid").alias("cid"), F.lit(1).alias("near"))
    pairs = df.select("vec_id", F.col("x").alias("a")).join(F.broadcast(c.select("cid", F.col("x").alias("b"))))  # every vector with the K seeds
    exact = pairs.where(V.euclidean_distance(F.col("a"), F.col("b")) < 1.2).select("vec_id", "cid", F.lit(1).alias("exact"))
    both = near.join(exact, ["vec_id", "cid"], "full_outer")
    return both.agg(F.count("exact").alias("n_pairs"), (F.count(F.col("near") + F.col("exact")) >= 0.9 * F.count("exact")).alias("enough"), F.count_if(F.col("exact").isNull()).alias("n_wrong"))


def _seeds(spark, sf_dir, seeds):
    """How many seeds there are, how many different, and how many are vectors of the table."""
    known = embeddings(spark, sf_dir).select(V.doubles(F.col("embedding")).alias("centroid")).distinct()
    met = seeds.join(known.withColumn("known", F.lit(1)), "centroid", "left")
    return met.agg(F.count("cid").alias("n_seeds"), F.count_distinct("cid").alias("n_ids"), F.count("known").alias("n_known"))


@query("SELECT 16::BIGINT AS n_seeds, 16::BIGINT AS n_ids, 16::BIGINT AS n_known")
def random_seed_sample(spark, sf_dir):
    return _seeds(spark, sf_dir, cluster.random_k(embeddings(spark, sf_dir), K, 7))


@query("SELECT 16::BIGINT AS n_seeds, 16::BIGINT AS n_ids, 16::BIGINT AS n_known")
def bernoulli_seed_sample(spark, sf_dir):
    return _seeds(spark, sf_dir, cluster.bernoulli_k(embeddings(spark, sf_dir), K, 7))

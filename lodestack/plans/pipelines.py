"""End-to-end plans: vocabulary, frequency table, index, search and evaluation."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import prefixed, tokens
from ..operators import ann, assign, bow, cluster, evaluate, rank, retrieval
from ..sources import extract, files
from ..storage import save, small
from .instrument import Phases


@dataclass
class Config:
    """A run's parameters. algorithm: hkm (two levels), kmeans (flat, top_k * bot_k words) or akm (approximate).

    ``bytes_``: akm over byte vectors, whose centroids are whole numbers.
    """

    algorithm: str = "hkm"
    top_k: int = 4
    bot_k: int = 4
    metric: str = "cosine"
    iterations: int = cluster.MAX_ITERATIONS
    delta: float = cluster.DELTA
    init: str = "first"
    seed: int = 7
    bytes_: bool = False


@dataclass
class Vocabulary:
    config: Config
    flat: assign.Vocabulary | None = None
    top: assign.Vocabulary | None = None
    bottoms: dict | DataFrame | None = None  # beyond the bound of a task: the table (top_id, cid, centroid)

    def words(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """``df`` with ``word``."""
        if self.flat is None:
            return assign.assign_two_level(df, self.top, self.bottoms, self.config.bot_k, vector).drop("top_id", "bot_id")
        return assign.assign(df, self.flat, vector).withColumnRenamed("cid", "word").drop("value")

    def flattened(self) -> assign.Vocabulary:
        return self.flat or cluster.merged(self.top, self.bottoms, self.config.bot_k)


def build_vocabulary(df: DataFrame, config: Config, order: str, vector: str = "embedding") -> Vocabulary:
    k = config.top_k * config.bot_k
    if config.algorithm == "hkm":
        top, bottoms = cluster.hierarchical(df, config.top_k, config.bot_k, order, config.metric, config.iterations, config.delta, vector)
        return Vocabulary(config, None, top, bottoms)
    if config.init == "first":
        seeds = cluster.first_k(df, k, order, vector)
    elif config.init == "random":
        seeds = cluster.random_k(df, k, config.seed, vector)
    else:
        seeds = cluster.bernoulli_k(df, k, config.seed, vector)
    if config.algorithm == "kmeans":
        return Vocabulary(config, cluster.kmeans(df, seeds, config.metric, config.iterations, config.delta, vector).vocabularies[0])
    if config.algorithm == "akm":
        return Vocabulary(config, ann.approximate_kmeans(df, seeds, config.iterations, config.delta, vector=vector, seed=config.seed, whole=config.bytes_).vocabularies[0])
    raise ValueError(f"unknown algorithm {config.algorithm}")


#: What an image's terms are made of.
BOTH, VISUAL, TEXT = 0, 1, 2


def terms(freq: DataFrame, text: DataFrame, key: str, modality: int = BOTH) -> DataFrame:
    """``(key, n_terms, terms)`` from visual words ``freq(key, words)`` and texts ``text(key, text)``, or from one of them."""
    if modality == BOTH:
        return bow.multimodal(freq, text, key)
    if modality not in (VISUAL, TEXT):
        raise ValueError(f"unknown modality {modality}")
    found = prefixed(tokens(F.col("words"))) if modality == VISUAL else tokens(F.col("text"))
    rows = (freq if modality == VISUAL else text).select(key, found.alias("t"))
    return rows.select(key, F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


def search_terms(found: DataFrame, queries: DataFrame, key: str, n: int | None = 20) -> DataFrame:
    """Ranked results for ``queries(key)`` among the rows of ``terms``."""
    index = retrieval.Index.build(found, key, tokens(F.col("terms")))
    asked = index.postings.join(queries.select(F.col(key).alias("doc")), "doc", "left_semi").select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf"))
    return retrieval.search(index, asked, n)


def frequency(df: DataFrame, vocabulary: Vocabulary, key: str, vector: str = "embedding") -> DataFrame:
    return bow.frequency(vocabulary.words(df, vector), key)


def search_images(freq: DataFrame, queries: DataFrame, key: str, n: int | None = 20) -> DataFrame:
    """Ranked results for ``queries(key)`` among the images of a frequency table."""
    index = retrieval.Index.build(freq, key, tokens(F.col("words")))
    asked = index.postings.join(queries.select(F.col(key).alias("doc")), "doc", "left_semi").select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf"))
    return retrieval.search(index, asked, n)


def run(df: DataFrame, config: Config, key: str, order: str, queries: DataFrame, judgments: DataFrame | None = None, n: int | None = 20, vector: str = "embedding") -> dict:
    """Vocabulary, frequency table, results and, with judgments, their average precision; with a log of the phases."""
    log = Phases(str(config))
    with log.phase("vocabulary"):
        vocabulary = build_vocabulary(df, config, order, vector)
    freq = frequency(df, vocabulary, key, vector)
    with log.phase("search"):
        results = search_images(freq, queries, key, n)
    ap = evaluate.average_precision(results, judgments) if judgments is not None else None
    return {"vocabulary": vocabulary, "frequency": freq, "results": results, "ap": ap, "phases": log}


def search_boxes(features: DataFrame, boxes: DataFrame, vocabulary: Vocabulary, freq: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """All boxed queries at once: features inside a query's box become its words, then one ranked search."""
    inside = features.join(small(boxes.withColumnRenamed("image", "_ls_image")), F.col(key) == F.col("_ls_image")).where(F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2")))
    asked = vocabulary.words(inside, "descriptor").where("word is not null").groupBy("query", F.col("word").cast("string").alias("term")).agg(F.count("*").alias("qtf"))
    return retrieval.search(retrieval.Index.build(freq, key, tokens(F.col("words"))), asked, n)


def combined(first: DataFrame, second: DataFrame, judgments: DataFrame, weight: float | None = None) -> DataFrame:
    """Average precision of two result lists fused; without a weight, the weight from their own precisions."""
    if weight is None:
        w = rank.oracle_weight(evaluate.average_precision(first, judgments), evaluate.average_precision(second, judgments))
        first, given = first.join(w, "query"), F.col("w")
    else:
        given = weight
    return evaluate.average_precision(rank.fuse(first, second, given), judgments)


def reranked_map(results: DataFrame, histogram: DataFrame, judgments: DataFrame, m: int, similarity: str = "cosine", norm: str = "raw") -> DataFrame:
    """Mean average precision after the first m results are put in order of their histograms' distance to the query's.

    ``histogram(key, term, tf)`` holds documents and queries; ``m`` 0 leaves the results as they are.
    """
    head = results.where(F.col("rank") <= m).select("query", "doc")
    distances = rank.histogram_distance(head, histogram.withColumnRenamed("key", "query"), histogram.withColumnRenamed("key", "doc"), similarity, norm)
    return evaluate.mean_average_precision(evaluate.average_precision(rank.rerank_prefix(results, distances, m), judgments))


def split_products(features: DataFrame, train: DataFrame, probe: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """Features of training images and of probe images, by membership."""
    part = lambda names: features.join(names.select(key).distinct(), key, "left_semi")
    return part(train), part(probe)


def folds(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Accuracy over all folds together: ``results(fold, query, doc, rank)`` and ``expected(fold, query, doc)``."""
    name = lambda df: df.withColumn("query", F.struct("fold", "query"))
    return evaluate.accuracy(evaluate.hit_at(name(results), name(expected), k))


def run_sequence_file(spark: SparkSession, path: str, extractor, config: Config, queries: DataFrame, judgments: DataFrame | None = None, n: int | None = 20) -> dict:
    """The whole run from a sequence file of pictures ``(key, bytes)``: features, vocabulary, frequency table, results."""
    log = Phases(path)
    with log.phase("features"):
        features = save(extract.extract(files.sequence_file(spark, path), extractor, "key", "value"), "features")
    found = run(features.withColumn("_ls_order", F.struct("image_id", "x", "y")), config, "image_id", "_ls_order", queries, judgments, n, "descriptor")
    found["phases"].rows[:0] = log.rows
    return found | {"features": features}


def extract_all(spark: SparkSession, paths: Iterable[str], extractor, out: str) -> Phases:
    """Features of each sequence file into ``out/part=<i>``, with a log of the times."""
    log = Phases("features")
    for i, path in enumerate(paths):
        with log.phase(path):
            extract.extract(files.sequence_file(spark, path), extractor, "key", "value").write.mode("overwrite").parquet(f"{out}/part={i}")
    return log


def build_all(df: DataFrame, configs: Iterable[Config], order: str, vector: str = "embedding") -> tuple[list[Vocabulary], Phases]:
    """A vocabulary for each configuration, with a log of the times."""
    log, out = Phases("vocabulary"), []
    for c in configs:
        with log.phase(f"{c.algorithm} {c.top_k}x{c.bot_k}"):
            out.append(build_vocabulary(df, c, order, vector))
    return out, log


def class_precision(freq: DataFrame, tests: DataFrame, key: str, k: int = 20) -> DataFrame:
    """``(class, n_queries, precision)`` of test images ``tests(key, class)``: a result counts if its name holds the class."""
    results = search_images(freq, tests, key, k)
    each = evaluate.precision_at_k_by_name(results, tests.select(F.col(key).alias("query"), "class"), k)
    by = each.join(tests.select(F.col(key).alias("query"), "class"), "query").groupBy("class")
    return by.agg(F.count("*").alias("n_queries"), F.round(F.avg("precision_at_k"), 6).alias("precision"))


def saved_map(spark: SparkSession, folders: dict[str, str], judgments: DataFrame) -> DataFrame:
    """``(run, n_queries, map)`` of results ``(query, doc, rank)`` that runs have saved."""
    out = None
    for name, path in folders.items():
        one = evaluate.mean_average_precision(evaluate.average_precision(spark.read.parquet(path), judgments)).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("run", "n_queries", "map")


def sweep(df: DataFrame, grid: Iterable[Config], key: str, order: str, queries: DataFrame, judgments: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(algorithm, top_k, bot_k, delta, init, map)`` for each configuration."""
    rows = []
    for c in grid:
        found = evaluate.mean_average_precision(run(df, c, key, order, queries, judgments, None, vector)["ap"]).first()
        rows.append((c.algorithm, c.top_k, c.bot_k, c.delta, c.init, found["map"]))
    return df.sparkSession.createDataFrame(rows, "algorithm string, top_k int, bot_k int, delta double, init string, map double")


def file_grid(spark: SparkSession, path: str, algorithm: str = "hkm", **options) -> list[Config]:
    """A configuration for each line ``topK botK`` of a grid file."""
    return [Config(algorithm, row[0], row[1] if len(row) > 1 else 1, **options) for row in files.sweep(spark, path)]


def grid(algorithms=("hkm",), sizes=((2, 2),), deltas=(1e-3, 1e-4, 1e-5, 1e-6), inits=("first", "random")) -> list[Config]:
    return [Config(a, t, b, delta=d, init=i) for a, (t, b), d, i in itertools.product(algorithms, sizes, deltas, inits)]

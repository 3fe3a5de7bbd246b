"""Stored models: a vocabulary, its index and its configuration in a folder, and searches with them in any session."""

from __future__ import annotations

import dataclasses
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import tokens
from ..operators import assign, cluster, retrieval
from ..sources import files, sinks
from ..storage import save
from . import pipelines

#: Queries whose terms are kept; the one that was used longest ago goes first.
KEPT_QUERIES = 1000


def write_vocabulary(spark: SparkSession, vocabulary: pipelines.Vocabulary, path: str) -> None:
    """``config`` as JSON text, ``flat`` or ``top`` and ``bottoms`` as tables of centroids."""
    sinks.write_config(spark, vocabulary.config, f"{path}/config")
    if vocabulary.flat is not None:
        _table(spark, vocabulary.flat).write.mode("overwrite").parquet(f"{path}/flat")
    else:
        _table(spark, vocabulary.top).write.mode("overwrite").parquet(f"{path}/top")
        cluster.bottom_table(spark, vocabulary.bottoms).write.mode("overwrite").parquet(f"{path}/bottoms")


def read_vocabulary(spark: SparkSession, path: str) -> pipelines.Vocabulary:
    config = pipelines.Config(**files.config(spark, f"{path}/config"))
    metric = "euclidean" if config.algorithm == "akm" else config.metric
    if config.algorithm != "hkm":
        return pipelines.Vocabulary(config, assign.Vocabulary.collect(spark.read.parquet(f"{path}/flat"), metric))
    top = assign.Vocabulary.collect(spark.read.parquet(f"{path}/top"), metric)
    rows = spark.read.parquet(f"{path}/bottoms")
    size = rows.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if (size[0] or 0) * (size[1] or 0) > assign.MODEL_NUMBERS:
        return pipelines.Vocabulary(config, None, top, rows)  # too large for one task: vectors meet it by top word
    bottoms: dict[int, list] = {}
    for r in rows.orderBy("top_id", "cid").collect():
        bottoms.setdefault(r.top_id, []).append((r.cid, r.centroid))
    return pipelines.Vocabulary(config, None, top, {t: assign.Vocabulary(np.array([c for c, _ in v]), np.array([x for _, x in v], float), metric) for t, v in bottoms.items()})


def _table(spark: SparkSession, v: assign.Vocabulary) -> DataFrame:
    return spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(v.ids, v.matrix)], "cid long, centroid array<double>")


@dataclasses.dataclass
class Engine:
    """A vocabulary and the index of a collection."""

    vocabulary: pipelines.Vocabulary
    index: retrieval.Index
    _terms: OrderedDict = dataclasses.field(default_factory=OrderedDict)

    @classmethod
    def build(cls, features: DataFrame, config: pipelines.Config, key: str, order: str, vector: str = "embedding") -> Engine:
        vocabulary = pipelines.build_vocabulary(features, config, order, vector)
        freq = save(pipelines.frequency(features, vocabulary, key, vector), "frequency")
        return cls(vocabulary, retrieval.Index.build(freq, key, tokens(F.col("words"))))

    def write(self, spark: SparkSession, path: str) -> None:
        write_vocabulary(spark, self.vocabulary, f"{path}/vocabulary")
        self.index.write(f"{path}/index")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Engine:
        return cls(read_vocabulary(spark, f"{path}/vocabulary"), retrieval.Index.read(spark, f"{path}/index"))

    def terms(self, features: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
        """``(query, term, qtf)`` of all images of ``features``."""
        words = self.vocabulary.words(features, vector).where("word is not null")
        return words.groupBy(F.col(key).alias("query"), F.col("word").cast("string").alias("term")).agg(F.count("*").alias("qtf"))

    def search(self, features: DataFrame, key: str, n: int | None = 20, vector: str = "embedding") -> DataFrame:
        """Ranked results for every image of ``features``, indexed or not."""
        asked = save(self.terms(features, key, vector), "terms")
        return retrieval.search(self.index, asked, n) if n is None else retrieval.search_alike(self.index, asked, n)

    def search_one(self, features: DataFrame, name, n: int | None = 20, vector: str = "embedding") -> DataFrame:
        """Ranked results for one image, all rows of ``features``; its terms are kept under its name for later searches."""
        if name not in self._terms:
            one = features.withColumn("_ls_query", F.lit(name))
            found = [(r.term, r.qtf) for r in self.terms(one, "_ls_query", vector).collect()]
            self._terms[name] = found
            if len(self._terms) > KEPT_QUERIES:
                self._terms.popitem(last=False)
        self._terms.move_to_end(name)
        asked = features.sparkSession.createDataFrame([(t, q) for t, q in self._terms[name]], "term string, qtf long")
        return retrieval.search(self.index, asked.select(F.lit(name).alias("query"), "term", "qtf"), n)

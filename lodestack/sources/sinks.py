"""Sinks: tables, text forms of centroids and frequencies, reports and configuration."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """One folder a key; rows of a key are brought together first, hot keys are split over several files."""
    df.repartition(*[F.col(k) for k in keys]).write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy(*keys).parquet(path)


def write_frequency(freq: DataFrame, path: str, key: str = "image_id") -> None:
    """``key <tab> count <tab> words`` lines."""
    freq.select(F.concat_ws("\t", F.col(key).cast("string"), F.col("n_words").cast("string"), "words").alias("value")).write.mode("overwrite").text(path)


def centroid_lines(centroids: DataFrame) -> DataFrame:
    """``value``: ``id <tab> {v0,v1,...}``."""
    body = F.concat_ws(",", F.col("centroid").cast("array<string>"))
    return centroids.select(F.concat(F.col("cid").cast("string"), F.lit("\t{"), body, F.lit("}")).alias("value"))


def write_centroids(centroids: DataFrame, path: str) -> None:
    centroid_lines(centroids).write.mode("overwrite").text(path)


def write_sequence_file(df: DataFrame, path: str, key: str, value: str) -> None:
    """Text keys and byte values, for readers of the old format."""
    df.select(F.col(key).cast("string"), F.col(value).cast("binary")).rdd.map(lambda r: (r[0], bytearray(r[1]))).saveAsSequenceFile(path)


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """One CSV file with a header, for small reports; sorted by ``order`` if given."""
    rows = df.coalesce(1)
    (rows.sortWithinPartitions(*order) if order else rows).write.mode("overwrite").csv(path, header=True)


def write_config(spark, config, path: str) -> None:
    """A dataclass or dict as JSON text."""
    body = json.dumps(dataclasses.asdict(config) if dataclasses.is_dataclass(config) else config, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_pictures(found: DataFrame, path: str) -> None:
    """``keyed_images`` as one sequence file a task; the key of a file that changed while it was read ends with ``.broken``."""
    key = F.when(F.col("whole"), F.col("key")).otherwise(F.concat("key", F.lit(".broken")))
    write_sequence_file(found.withColumn("key", key), path, "key", "content")


def write_archives(entries: DataFrame, path: str) -> None:
    """Entries of archives ``(archive, name, content)``: a folder for each archive, named by its stem."""
    named = entries.withColumn("archive", texts.stem(texts.basename(F.col("archive"))))
    write_partitioned(named, path, "archive")


def merge_text(spark, folder: str, path: str) -> None:
    """All lines of a folder's text files in one file, by file name and place."""
    rows = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows.orderBy("file", "at").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_levels(top: DataFrame, bottoms: DataFrame, path: str) -> None:
    """Centroid lines of ``top(cid, centroid)`` and ``bottoms(top_id, cid, centroid)``: ``level=0/id=0`` and ``level=1/id=<top_id>``."""
    lines = centroid_lines(top).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("id"), "value")
    body = F.concat(F.col("cid").cast("string"), F.lit("\t{"), F.concat_ws(",", F.col("centroid").cast("array<string>")), F.lit("}"))
    below = bottoms.select(F.lit(1).alias("level"), F.col("top_id").cast("long").alias("id"), body.alias("value"))
    lines.unionByName(below).repartition("level", "id").write.mode("overwrite").partitionBy("level", "id").text(path)


def append_log(spark, rows: DataFrame, path: str) -> None:
    """``rows(task, phase, started, seconds)`` as tab-separated lines behind those that are there."""
    line = F.concat_ws("\t", "task", "phase", F.col("started").cast("string"), F.col("seconds").cast("string"))
    rows.select(line.alias("value")).coalesce(1).write.mode("append").text(path)


def map_report(ap: DataFrame) -> DataFrame:
    """``(query, ap)`` in order of the queries, then a row ``mean`` with the mean."""
    rows = ap.select(F.lit(0).alias("o"), F.col("query").cast("string").alias("query"), "ap")
    return rows.unionByName(ap.agg(F.lit(1).alias("o"), F.lit("mean").alias("query"), F.round(F.avg("ap"), 6).alias("ap"))).orderBy("o", "query").drop("o")


def rename_files(spark, folder: str, suffix: str) -> int:
    """Puts ``suffix`` behind the name of every file of a folder; returns how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(path) if f.isFile()]
    for p in found:
        fs.rename(p, p.suffix(suffix))
    return len(found)


def put(spark, path: str, body: str) -> None:
    """One small text file of a given name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()

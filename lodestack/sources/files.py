"""Sources: blobs, archives, legacy text formats and ground truth files."""

from __future__ import annotations

import json
import tarfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts, vectors
from ..storage import save, small


def blobs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Whole files: ``path, modificationTime, length, content``; content is read only if it is selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Blobs whose name is a picture's and does not end with a tilde."""
    return blobs(spark, path).where(texts.is_image(F.col("path")))


def keyed_images(spark: SparkSession, path: str) -> DataFrame:
    """``(key, content, whole)`` of non-empty pictures, ``folder/name`` as key; ``whole`` is false if a file changed its size
    between its listing and its reading."""
    key = F.concat_ws("/", texts.parent(F.col("path")), texts.basename(F.col("path")))
    return images(spark, path).where("length > 0").select(key.alias("key"), "content", (F.length("content") == F.col("length")).alias("whole"))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Pictures decoded by the image source; broken ones are dropped."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)


def resized(pictures: DataFrame, limit: int = 2048) -> DataFrame:
    """``(origin, height, width, nChannels, data)`` of decoded pictures, made to fit into a square of ``limit`` by their
    nearest pixels; smaller ones stay as they are."""

    def run(batches):
        for batch in batches:
            for origin, height, width, channels, data in zip(*batch.columns):
                h, w, c = height.as_py(), width.as_py(), channels.as_py()
                ratio = min(1.0, limit / w, limit / h)
                new_h, new_w = max(1, int(h * ratio)), max(1, int(w * ratio))
                pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, c)
                pixels = pixels[(np.arange(new_h) * h // new_h)[:, None], (np.arange(new_w) * w // new_w)[None, :]]
                yield pa.RecordBatch.from_pydict({"origin": [origin.as_py()], "height": pa.array([new_h], pa.int32()), "width": pa.array([new_w], pa.int32()), "nChannels": pa.array([c], pa.int32()), "data": [pixels.tobytes()]})

    cells = pictures.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return cells.mapInArrow(run, "origin string, height int, width int, nChannels int, data binary")


def xml_config(spark: SparkSession, path: str, root: str) -> dict:
    """Attributes of an XML file's root element."""
    row = spark.read.format("xml").option("rowTag", root).option("attributePrefix", "").option("inferSchema", False).load(path).first()
    return row.asDict() if row else {}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, folder, length)`` of all files, without reading them."""
    return blobs(spark, path).select("path", texts.basename(F.col("path")).alias("name"), texts.parent(F.col("path")).alias("folder"), "length")


def folders(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, path, n_files)`` of all folders that hold files, without reading these."""
    rows = blobs(spark, path).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"))
    return rows.groupBy("path").agg(F.count("*").alias("n_files")).select(texts.basename(F.col("path")).alias("folder"), "path", "n_files")


def tars(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, name, content)`` of every regular file in every ``*.tar`` under ``path``; unreadable archives give none."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                archive = archive.as_py()
                try:
                    with tarfile.open(fileobj=pa.BufferReader(content.as_buffer())) as tar:
                        for entry in tar:
                            if entry.isfile():
                                yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [entry.name], "content": [tar.extractfile(entry).read()]})
                except tarfile.TarError:
                    continue

    found = blobs(spark, path).where(F.col("path").endswith(".tar")).select("path", "content")
    return found.mapInArrow(run, "archive string, name string, content binary")


def sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of a sequence file of text and bytes."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path).map(lambda kv: (str(kv[0]), bytearray(kv[1]))), "key string, value binary")


def features(spark: SparkSession, path: str, n: int = 128) -> DataFrame:
    """Feature lines ``scale orientation x y d0 ...`` with their file's name."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), texts.feature_fields(F.col("value"), n).alias("f"))
    return rows.select(texts.basename(F.col("file")).alias("image_id"), "f.*")


def centroids(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``(cid, centroid)`` from lines ``id <tab> {v0,v1,...}`` or ``id <tab> {i:v,...}`` (missing is 0)."""
    body = F.regexp_extract("value", r"\{(.*?)\}", 1)
    rows = spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("cid"), body.alias("body")).where("body <> ''")
    one = F.when(F.col("body").contains(":"), vectors.parse_sparse(F.col("body"), dim)).otherwise(vectors.parse_dense(F.col("body")))
    return rows.select("cid", one.alias("centroid"))


def checked_centroids(found: DataFrame, k: int) -> DataFrame:
    """``found`` if its ids are 0 to k - 1, each once; else an error."""
    state = found.agg(F.count("*"), F.countDistinct("cid"), F.min("cid"), F.max("cid")).first()
    if tuple(state) != (k, k, 0, k - 1):
        raise ValueError(f"centroids are missing or double: {state[0]} rows, {state[1]} ids, {state[2]} to {state[3]}, expected {k}")
    return found


def judgments(spark: SparkSession, folder: str) -> DataFrame:
    """``(query, doc, grade)`` from files ``<query>_<good|ok|junk>.txt`` with an image a line; double lines count once."""
    name = texts.basename(F.col("_metadata.file_path"))
    rows = spark.read.text(folder, pathGlobFilter="*_*.txt").select(F.btrim("value").alias("doc"), name.alias("name"))
    parts = rows.select("doc", F.regexp_extract("name", r"^(.*)_(good|ok|junk)\.txt$", 1).alias("query"), F.regexp_extract("name", r"^(.*)_(good|ok|junk)\.txt$", 2).alias("grade"))
    return parts.where("grade <> '' and doc <> ''").select("query", "doc", "grade").distinct()


def query_boxes(spark: SparkSession, folder: str, prefix: str = "oxc1_") -> DataFrame:
    """``(query, image, x1, y1, x2, y2)`` from files ``<query>_query.txt`` with ``<prefix><image> x1 y1 x2 y2``."""
    rows = spark.read.text(folder, pathGlobFilter="*_query.txt").where("trim(value) <> ''")
    f = F.split(F.btrim("value"), r"\s+")
    numbers = [F.element_at(f, i + 2).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    query = F.regexp_extract(texts.basename(F.col("_metadata.file_path")), r"^(.*)_query\.txt$", 1)
    return rows.select(query.alias("query"), F.concat(F.regexp_replace(f[0], f"^{prefix}", ""), F.lit(".jpg")).alias("image"), *numbers)


def frequency_map(spark: SparkSession, path: str) -> DataFrame:
    """``(image, words)`` from ``folder//image <tab> count <tab> words`` lines."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) >= 3")
    return rows.select(F.coalesce(F.try_element_at(F.split(F.col("f")[0], "//"), F.lit(2)), F.col("f")[0]).alias("image"), F.col("f")[2].alias("words"))


def text_map(spark: SparkSession, path: str) -> DataFrame:
    """``(category, image, words)`` from ``<category>/map.txt`` files with ``image --- words`` lines."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, pathGlobFilter="map.txt")
    cut = F.split("value", "---", 2)
    return rows.where(F.col("value").contains("---")).select(
        texts.parent(F.col("_metadata.file_path")).alias("category"), texts.stem(F.btrim(cut[0])).alias("image"), F.btrim(cut[1]).alias("words")
    )


def titles(spark: SparkSession, path: str) -> DataFrame:
    """``(object, words)``: the first line of every ``<object>/title.txt``."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True, pathGlobFilter="title.txt")
    return rows.select(texts.parent(F.col("_metadata.file_path")).alias("object"), F.split_part("value", F.lit("\n"), F.lit(1)).alias("words"))


def category_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(category, image)`` from lines ``category image image ...``."""
    words = F.split(F.btrim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(words[0].alias("category"), F.explode(F.slice(words, 2, F.size(words))).alias("image"))
    return rows


def sweep(spark: SparkSession, path: str) -> list[list[int]]:
    """A parameter grid: whitespace-separated numbers, a configuration a line."""
    return [[int(x) for x in r.value.split()] for r in spark.read.text(path).collect() if r.value.strip()]


def config(spark: SparkSession, path: str) -> dict:
    """A run's configuration, written by ``sinks.write_config``."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def resource_log(spark: SparkSession, path: str) -> DataFrame:
    """``(ts, user, containers, mem)`` from snapshots: a ``TimeStamp: ms`` line, then table rows that belong to it.

    A row's time is in a line before it. Lines are numbered by file and place (tasks read them in order), and each part's
    last time is handed on to the next, so a long log is read by several tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = save(lines.select("file", "block", "at", F.nullif(F.regexp_extract("value", r"TimeStamp:\s*(\d+)", 1), F.lit("")).cast("long").alias("ms"), "value"), "log")
    last = lines.where("ms is not null").groupBy("file", "block").agg(F.max_by("ms", "at").alias("last"))
    blocks = lines.select("file", "block").distinct().join(last, ["file", "block"], "left")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", before.alias("before"))
    own = F.last("ms", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("at"))
    line = lines.join(small(save(blocks, "blocks")), ["file", "block"]).withColumn("ms", F.coalesce(own, "before")).where("ms is not null")
    f = F.split(F.btrim("value"), r"\s+")
    fine = line.select("ms", f.alias("f")).where("size(f) >= 9 and f[6] rlike '^[0-9]+$'")
    number = F.regexp_extract(F.col("f")[8], r"^(\d+)", 1).cast("int")
    return fine.select(F.timestamp_millis("ms").alias("ts"), F.col("f")[3].alias("user"), F.col("f")[6].cast("int").alias("containers"), number.alias("mem"))


def phase_log(spark: SparkSession, path: str) -> DataFrame:
    """``(file, phase, mark, ms)`` from lines ``$<phase><Start|End>$ <ms>``."""
    pattern = r"^\$(.+?)(Start|End)\$?\s+(\d+)"
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    part = lambda i: F.regexp_extract("value", pattern, i)
    return rows.select("file", part(1).alias("phase"), part(2).alias("mark"), part(3).alias("ms")).where("mark <> ''").withColumn("ms", F.col("ms").cast("long"))

"""Queries on sources and sinks: tables go out in a file format and come back by the source that reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import assign, bow, cluster, evaluate
from ..plans import pipelines
from ..sources import files, sinks
from ..storage import scratch_path
from .evaluation import _AP, judgments
from .registry import query, table
from .retrieval import text_results
from .vectors import _H, _W, BOT_K, TOP_K, _long, centroids, embeddings, words


@query("SELECT CAST(page_id AS VARCHAR) AS key, CAST(octet_length(encode(html)) AS BIGINT) AS length, md5(html) AS digest FROM pages")
def sequence_file_round_trip(spark, sf_dir):
    path = scratch_path(spark, "sequence")
    sinks.write_sequence_file(table(spark, sf_dir, "pages"), path, "page_id", "html")
    return files.sequence_file(spark, path).select("key", F.length("value").cast("long").alias("length"), F.md5("value").alias("digest"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def partitioned_sink(spark, sf_dir):
    path = scratch_path(spark, "partitioned")
    sinks.write_partitioned(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), path, "lang")
    return spark.read.parquet(path).select("doc_id", F.col("lang").cast("string").alias("lang"), "source", "n_chars")


@query("SELECT 'lang=' || lang AS folder, 1::BIGINT AS n_files, CAST(sum(length(source) + 1) AS BIGINT) AS length FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang")
def file_listing(spark, sf_dir):
    """Folders and files of a text sink, listed without reading them."""
    path = scratch_path(spark, "texts")
    rows = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    rows.select("lang", F.col("source").alias("value")).repartition("lang").write.partitionBy("lang").text(path)
    listed = files.listing(spark, path).where(F.col("name").endswith(".txt")).groupBy("folder").agg(F.sum("length").alias("length"))
    return files.folders(spark, path).where(F.col("folder").startswith("lang=")).join(listed, "folder").select("folder", "n_files", "length")


@query(f"WITH {_W} SELECT CAST(vec_id // 10 AS VARCHAR) AS image, string_agg(CAST(cid AS VARCHAR), ' ' ORDER BY cid) AS words FROM w GROUP BY ALL")
def frequency_text_round_trip(spark, sf_dir):
    path = scratch_path(spark, "frequency")
    sinks.write_frequency(bow.frequency(words(spark, sf_dir), "image_id"), path)
    return files.frequency_map(spark, path)


@query("""SELECT l_quantity AS scale, l_discount AS orientation, l_extendedprice AS x, l_tax AS y, count(*) AS n, CAST(sum(len([l_quantity, l_tax])) AS BIGINT) AS n_values
FROM lineitem GROUP BY ALL""")
def feature_text_round_trip(spark, sf_dir):
    path = scratch_path(spark, "features")
    cells = [F.col(c).cast("string") for c in ("l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_quantity", "l_tax")]
    table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", *cells).alias("value")).write.text(path)
    return files.features(spark, path, 2).groupBy("scale", "orientation", "x", "y").agg(F.count("*").alias("n"), F.sum(F.size("descriptor")).alias("n_values"))


@query("SELECT event_type AS phase, 'Start' AS mark, epoch_us(ts) // 1000 AS ms, count(*) AS n FROM events GROUP BY ALL")
def phase_log_round_trip(spark, sf_dir):
    path = scratch_path(spark, "phases")
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    table(spark, sf_dir, "events").select(F.concat(F.lit("$"), "event_type", F.lit("Start$ "), ms).alias("value")).write.text(path)
    return files.phase_log(spark, path).groupBy("phase", "mark", "ms").agg(F.count("*").alias("n"))


@query("""SELECT epoch_us(ts) // 1000 AS ms, 'user' || user_id AS "user", 1 AS containers, CAST(floor(value) AS INTEGER) AS mem, count(*) AS n FROM events WHERE value >= 0 GROUP BY ALL""")
def resource_log_round_trip(spark, sf_dir):
    """Every event as a snapshot of one row, whose time stands in the line before it."""
    path = scratch_path(spark, "resources")
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    row = F.concat_ws(" ", F.lit("a b c"), F.concat(F.lit("user"), F.col("user_id").cast("string")), F.lit("e f 1 g"), F.concat(F.floor("value").cast("string"), F.lit("M")))
    events = table(spark, sf_dir, "events").where("value >= 0")
    events.select(F.explode(F.array(F.concat(F.lit("TimeStamp: "), ms), row)).alias("value")).write.text(path)
    found = files.resource_log(spark, path).select(F.unix_millis("ts").alias("ms"), "user", "containers", "mem")
    return found.groupBy("ms", "user", "containers", "mem").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS query, n_name AS doc, CASE n_nationkey % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'ok' ELSE 'junk' END AS grade FROM nation")
def judgment_files(spark, sf_dir):
    """Ground truth as files ``<query>_<grade>.txt``, of regions and their nations."""
    path, grades = scratch_path(spark, "truth"), ("good", "ok", "junk")
    found: dict[str, list[str]] = {}
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        found.setdefault(f"{r.n_regionkey}_{grades[r.n_nationkey % 3]}.txt", []).append(r.n_name)
    for name, names in found.items():
        sinks.put(spark, f"{path}/{name}", "\n".join(names) + "\n")
    return files.judgments(spark, path)


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS query, replace(r_name, ' ', '_') || '.jpg' AS image, r_regionkey + 0.5::DOUBLE AS x1, 1.5::DOUBLE AS y1, r_regionkey + 10.0::DOUBLE AS x2, 20.0::DOUBLE AS y2 FROM region""")
def query_box_files(spark, sf_dir):
    path = scratch_path(spark, "boxes")
    for r in table(spark, sf_dir, "region").collect():  # 5 rows at any scale
        sinks.put(spark, f"{path}/{r.r_regionkey}_query.txt", f"oxc1_{r.r_name.replace(' ', '_')} {r.r_regionkey + 0.5} 1.5 {r.r_regionkey + 10} 20\n")
    return files.query_boxes(spark, path)


@query("SELECT CAST(n_regionkey AS VARCHAR) AS category, n_name AS image, 'nation ' || n_nationkey AS words FROM nation")
def text_map_files(spark, sf_dir):
    path = scratch_path(spark, "maps")
    found: dict[int, list[str]] = {}
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        found.setdefault(r.n_regionkey, []).append(f"{r.n_name}.jpg --- nation {r.n_nationkey}")
    for region, lines in found.items():
        sinks.put(spark, f"{path}/{region}/map.txt", "\n".join(lines) + "\n")
    return files.text_map(spark, path)


@query("SELECT * FROM (VALUES ('algorithm', 'akm'), ('top_k', '7'), ('seed', '3')) AS t(key, value)")
def config_round_trip(spark, sf_dir):
    path = scratch_path(spark, "config")
    sinks.write_config(spark, pipelines.Config("akm", 7, seed=3), path)
    found = pipelines.Config(**files.config(spark, path))
    return spark.createDataFrame([(k, str(getattr(found, k))) for k in ("algorithm", "top_k", "seed")], "key string, value string")


@query("SELECT lang, source, count(*) AS n_docs FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def csv_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    rows = table(spark, sf_dir, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    sinks.write_report(rows, path, "lang", "source")
    return spark.read.schema("lang string, source string, n_docs long").csv(path, header=True)


@query(_H + f"""SELECT 0 AS level, 0::BIGINT AS id, vec_id AS cid, CAST(i AS INTEGER) AS i, round(v, 6) AS value FROM (
  SELECT vec_id, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i FROM e WHERE vec_id < {TOP_K})
UNION ALL SELECT 1, top_id, bot_id, CAST(i AS INTEGER), round(v, 6) FROM (SELECT top_id, bot_id, unnest(c) AS v, generate_subscripts(c, 1) - 1 AS i FROM s)""")
def level_dump(spark, sf_dir):
    """Both levels' centroids as text by level and cluster, read back."""
    path, df = scratch_path(spark, "levels"), embeddings(spark, sf_dir)
    top = centroids(spark, sf_dir, TOP_K)
    split = assign.assign(df.select("vec_id", "embedding"), assign.Vocabulary.collect(top)).withColumnRenamed("cid", "top_id")
    seeds = [(t, i, c) for t, found in cluster.bottom_seeds(split, BOT_K, "vec_id").items() for i, c in enumerate(found)]
    sinks.write_levels(top.withColumn("centroid", F.col("centroid").cast("array<double>")), spark.createDataFrame(seeds, "top_id long, cid long, centroid array<double>"), path)
    out = None
    for row in spark.read.text(path).select("level", "id").distinct().collect():  # as many as there are vocabularies
        one = _long(files.centroids(spark, f"{path}/level={row.level}/id={row.id}", 64), "centroid")
        one = one.select(F.lit(row.level).cast("int").alias("level"), F.lit(row.id).cast("long").alias("id"), "cid", "i", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(_AP + " SELECT CAST(query AS VARCHAR) AS query, ap FROM ap UNION ALL SELECT 'mean', round(avg(ap), 6) FROM ap")
def map_report(spark, sf_dir):
    results = text_results(spark, sf_dir, None)
    return sinks.map_report(evaluate.average_precision(results, judgments(spark, sf_dir, results)))


@query("SELECT n_name, n_name || '_small' AS renamed, ends_with(n_name, 'A') OR ends_with(n_name, '1') AS matched FROM nation")
def name_suffixes(spark, sf_dir):
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_name", texts.suffixed(name, "_small").alias("renamed"), texts.ends_with_any(name, ["A", "1"]).alias("matched"))

"""Queries on objects, files, paths, boxes and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import bow, rank, retrieval
from ..plans import instrument
from ..streaming import snapshots
from .registry import query, table
from .retrieval import _CUT


@query(f"""WITH t AS (SELECT conv_id, unnest({_CUT}) AS term FROM conversations)
SELECT conv_id, term, CAST(ceil(count(*) / 2) AS BIGINT) AS repeats FROM t GROUP BY ALL""")
def object_avg_histogram(spark, sf_dir):
    return bow.object_histogram(table(spark, sf_dir, "conversations"), "conv_id", texts.tokens(F.col("text")))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_members FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey HAVING count(l_orderkey) < 2""")
def incomplete_objects(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return bow.incomplete(table(spark, sf_dir, "orders"), members, "o_orderkey", "l_linenumber")


@query("SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY ALL")
def category_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
g AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT p.pos, o_orderkey, c_custkey FROM p JOIN g ON g.pos = p.pos // 3""")
def positional_join(spark, sf_dir):
    many = rank.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return rank.positional_join(many, rank.numbered(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")).select("pos", "o_orderkey", "c_custkey")


@query("""WITH s AS (SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS suffix FROM nation)
SELECT c_custkey, n_nationkey FROM customer JOIN s ON ends_with(c_name, suffix)
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(suffix) DESC, n_nationkey) = 1""")
def suffix_join(spark, sf_dir):
    """Names with the longest key that they end with."""
    keys = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("suffix"))
    return rank.suffix_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), keys, "c_name", "suffix").select("c_custkey", "n_nationkey")


@query("""SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
AND NOT (ends_with(split_part(url, '/', len(string_split(url, '/'))), '2') OR ends_with(split_part(url, '/', len(string_split(url, '/'))), '7.html'))""")
def filtered_index_rows(spark, sf_dir):
    """Rows to index without excluded keys and without names of certain ends."""
    pages = table(spark, sf_dir, "pages").select("page_id", texts.basename(F.col("url")).alias("name"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return retrieval.without(pages, toxic, "page_id", "name", ("2", "7.html")).select("page_id")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query(f"""WITH d AS (SELECT doc_id, unnest({_CUT}) AS term FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT term, count(DISTINCT doc_id) AS df FROM d GROUP BY term""")
def anti_join_index(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    kept = retrieval.without(table(spark, sf_dir, "documents").select("doc_id", "text"), toxic, "doc_id")
    return retrieval.Index.build(kept, "doc_id", texts.tokens(F.col("text"))).terms


@query("""SELECT doc_id AS doc, 'good' AS grade FROM labels WHERE quality = 1 AND toxic = 0 UNION SELECT doc_id, 'ok' FROM labels WHERE quality = 0 AND toxic = 0
UNION SELECT doc_id, 'junk' FROM labels WHERE toxic = 1""")
def union_judgments(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    part = lambda where, grade: labels.where(where).select(F.col("doc_id").alias("doc"), F.lit(grade).alias("grade"))
    return part("quality = 1 and toxic = 0", "good").unionByName(part("quality = 0 and toxic = 0", "ok")).unionByName(part("toxic = 1", "junk")).distinct()


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 5000 AND 20000")
def bbox_filter(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return points.where(texts.inside(F.col("l_quantity"), F.col("l_extendedprice"), 10, 5000, 20, 20000))


@query("""WITH s AS (SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents),
b AS (SELECT unnest([100000, 200000, 400000])::BIGINT AS budget)
SELECT doc_id, n_chars, before, budget FROM s JOIN b ON before <= budget""")
def size_budget_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rank.size_prefixes(docs, [100_000, 200_000, 400_000], "n_chars", "doc_id", 16).select("doc_id", "n_chars", "before", "budget")


@query("""WITH d AS (SELECT p_partkey, p_size * 100 AS w, CAST(floor(p_retailprice * 2) AS INTEGER) AS h FROM part)
SELECT p_partkey, CAST(floor(w * least(1, 2048::DOUBLE / w, 2048::DOUBLE / h)) AS INTEGER) AS new_w, CAST(floor(h * least(1, 2048::DOUBLE / w, 2048::DOUBLE / h)) AS INTEGER) AS new_h FROM d""")
def resize_plan(spark, sf_dir):
    dims = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), F.floor(F.col("p_retailprice") * 2).cast("int").alias("h"))
    ratio = texts.fit_ratio(F.col("w"), F.col("h"))
    return dims.select("p_partkey", F.floor(F.col("w") * ratio).cast("int").alias("new_w"), F.floor(F.col("h") * ratio).cast("int").alias("new_h"))


@query("""SELECT page_id, split_part(url, '/', len(string_split(url, '/'))) AS base, string_split(url, '/')[-2] AS folder,
  split_part(split_part(url, '/', len(string_split(url, '/'))), '.', 1) AS stem, split_part(split_part(url, '/', len(string_split(url, '/'))), '_', 1) AS class FROM pages""")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", texts.basename(url).alias("base"), texts.parent(url).alias("folder"), texts.stem(texts.basename(url)).alias("stem"), texts.synset(url).alias("class")
    )


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS scale, l_discount AS orientation, l_extendedprice AS x, l_tax AS y, 3 AS n_values,
  round(l_quantity + l_discount + l_tax, 6) AS total FROM lineitem""")
def parse_feature_line(spark, sf_dir):
    """Feature lines made from numbers, and parsed back."""
    order = ["l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_quantity", "l_discount", "l_tax"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", *[F.col(c).cast("string") for c in order]).alias("line"))
    f = lines.select("l_orderkey", "l_linenumber", texts.feature_fields(F.col("line"), 3).alias("f"))
    total = F.aggregate("f.descriptor", F.lit(0.0), lambda s, x: s + x)
    return f.select("l_orderkey", "l_linenumber", "f.scale", "f.orientation", "f.x", "f.y", F.size("f.descriptor").alias("n_values"), F.round(total, 6).alias("total"))


@query("""WITH a AS (SELECT CAST(floor(min(epoch(ts))) AS BIGINT) AS a FROM events WHERE user_id = (SELECT min(user_id) FROM events))
SELECT CAST(floor(epoch(ts)) AS BIGINT) - a AS second, count(*) AS containers, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS mem
FROM events, a WHERE user_id = (SELECT min(user_id) FROM events) AND CAST(floor(epoch(ts)) AS BIGINT) BETWEEN a AND a + 100000000 GROUP BY ALL""")
def resource_snapshot_agg(spark, sf_dir):
    """One user's events as snapshots: an event is a container, its value the memory."""
    events = table(spark, sf_dir, "events")
    user = events.agg(F.min("user_id")).first()[0]
    log = events.where(F.col("user_id") == user).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"), F.lit(1).cast("long").alias("containers"), F.floor("value").alias("mem"))
    start = log.agg(F.min(F.unix_seconds("ts"))).first()[0]
    return instrument.usage(log, user, start, start + 100_000_000).select("second", "containers", "mem")


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_snapshot(spark, sf_dir):
    return snapshots.tumbling(table(spark, sf_dir, "events"), 3600, "event_type").withColumn("total", F.round("total", 4))


@query("""SELECT user_id, event_type, ts AS started, round(gap / 1e6, 3) AS seconds
FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)) - epoch_us(ts) AS gap FROM events) WHERE gap IS NOT NULL""")
def phase_durations(spark, sf_dir):
    return instrument.durations(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "user_id", "ts", "event_type")

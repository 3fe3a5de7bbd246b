import io
import struct
import tarfile
import zlib
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from lodestack.operators import assign, evaluate, rank
from lodestack.plans import instrument, pipelines, stored
from lodestack.sources import extract, files, sinks
from lodestack.streaming import snapshots


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_blobs_and_features(spark, tmp_path):
    put(tmp_path / "a" / "x.jpg", "abc" * 50)
    put(tmp_path / "a" / "y.txt", "no")
    assert [r.path.endswith("x.jpg") for r in files.images(spark, str(tmp_path)).select("path").collect()] == [True]
    assert {(r.name, r.folder, r.length) for r in files.listing(spark, str(tmp_path)).collect()} == {("x.jpg", "a", 150), ("y.txt", "a", 2)}
    found, seen = extract.observed(extract.extract(files.images(spark, str(tmp_path)), extract.byte_histogram))
    assert found.count() == 3
    bad = extract.extract(files.images(spark, str(tmp_path)), lambda data: 1 / 0)
    assert bad.count() == 0


def test_keyed_images_and_xml(spark, tmp_path):
    put(tmp_path / "a" / "x.jpg", "abc")
    put(tmp_path / "a" / "empty.jpg", "")
    put(tmp_path / "a" / "y.jpg~", "no")
    assert [(r.key, bytes(r.content), r.whole) for r in files.keyed_images(spark, str(tmp_path)).collect()] == [("a/x.jpg", b"abc", True)]
    assert files.decoded(spark, str(tmp_path / "a")).count() == 0
    put(tmp_path / "c.xml", '<conf terms="t" clusterNum="4"/>')
    assert files.xml_config(spark, str(tmp_path / "c.xml"), "conf") == {"terms": "t", "clusterNum": "4"}


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        info = tarfile.TarInfo("d/one.jpg")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"xyz"))
    put(tmp_path / "broken.tar", "nonsense")
    assert [(r.name, bytes(r.content)) for r in files.tars(spark, str(tmp_path)).collect()] == [("d/one.jpg", b"xyz")]


def test_sequence_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"12"))], "k string, v binary")
    sinks.write_sequence_file(rows, str(tmp_path / "s"), "k", "v")
    assert [(r.key, bytes(r.value)) for r in files.sequence_file(spark, str(tmp_path / "s")).collect()] == [("a", b"12")]


def test_centroids(spark, tmp_path):
    put(tmp_path / "c.txt", "0\t{1.0,2.0}\n1\t{1:5.0}\nnoise\n")
    found = files.centroids(spark, str(tmp_path / "c.txt"), 2)
    assert {r.cid: r.centroid for r in files.checked_centroids(found, 2).collect()} == {0: [1.0, 2.0], 1: [0.0, 5.0]}
    try:
        files.checked_centroids(found, 3)
    except ValueError:
        pass
    else:
        raise AssertionError
    sinks.write_centroids(found, str(tmp_path / "out"))
    assert files.centroids(spark, str(tmp_path / "out"), 2).count() == 2


def test_ground_truth(spark, tmp_path):
    put(tmp_path / "all_1_query.txt", "oxc1_img_7 1 2.5 3 4\n")
    put(tmp_path / "all_1_good.txt", "a\nb\na\n")
    put(tmp_path / "all_1_junk.txt", "c\n")
    assert {tuple(r) for r in files.judgments(spark, str(tmp_path)).collect()} == {("all_1", "a", "good"), ("all_1", "b", "good"), ("all_1", "c", "junk")}
    assert tuple(files.query_boxes(spark, str(tmp_path)).first()) == ("all_1", "img_7.jpg", 1.0, 2.5, 3.0, 4.0)


def test_text_formats(spark, tmp_path):
    put(tmp_path / "f.txt", "root//im.jpg\t2\t4 5\nplain\t1\t9\n")
    assert {tuple(r) for r in files.frequency_map(spark, str(tmp_path / "f.txt")).collect()} == {("im.jpg", "4 5"), ("plain", "9")}
    put(tmp_path / "m" / "cats" / "map.txt", "x.jpg --- soft paws\n")
    assert tuple(files.text_map(spark, str(tmp_path / "m")).first()) == ("cats", "x", "soft paws")
    put(tmp_path / "o" / "17" / "title.txt", "red shoe\nmore\n")
    assert tuple(files.titles(spark, str(tmp_path / "o")).first()) == ("17", "red shoe")
    put(tmp_path / "q.txt", "dogs a b\n\n")
    assert {tuple(r) for r in files.category_queries(spark, str(tmp_path / "q.txt")).collect()} == {("dogs", "a"), ("dogs", "b")}
    put(tmp_path / "sweep.txt", "2 2\n10 10\n")
    assert files.sweep(spark, str(tmp_path / "sweep.txt")) == [[2, 2], [10, 10]]


def test_config(spark, tmp_path):
    sinks.write_config(spark, pipelines.Config(top_k=9), str(tmp_path / "c"))
    assert files.config(spark, str(tmp_path / "c"))["top_k"] == 9


def test_logs(spark, tmp_path):
    row = "job_1 1 2 bob x y 3 z 512M"
    put(tmp_path / "r.txt", f"TimeStamp: 1000\nTotal jobs:1\nheader\n{row}\n{row}\nTimeStamp: 4000\nTotal jobs:0\n{row}\n")
    log = files.resource_log(spark, str(tmp_path / "r.txt"))
    assert {tuple(r) for r in instrument.usage(log, "bob", 1, 100).collect()} == {(0, 6, 1024), (3, 3, 512)}
    put(tmp_path / "p.txt", "#Task: x\n$FEStart$ 100\n$FEEnd$ 350\n")
    assert [(r.phase, r.mark, r.ms) for r in files.phase_log(spark, str(tmp_path / "p.txt")).orderBy("ms").collect()] == [("FE", "Start", 100), ("FE", "End", 350)]
    phases = instrument.Phases("t")
    with phases.phase("one"):
        pass
    assert phases.table(spark).count() == 1


def test_stream_matches_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, s), "a" if s % 2 else "b", float(s)) for s in range(0, 50)] + [(datetime(2024, 1, 1, 1, 0, 0), "a", 0.0)]
    events = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    events.write.parquet(str(tmp_path / "in"))
    out = snapshots.stream(spark, str(tmp_path / "in"), events.schema, 10, "kind")
    snapshots.run(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    batch = {tuple(r) for r in snapshots.tumbling(events.where("ts < '2024-01-01 00:30:00'"), 10, "kind").collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], ["k", "v"])
    sinks.write_partitioned(rows, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 2").first()["v"] == "b"
    sinks.write_report(rows, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    freq = spark.createDataFrame([("im", 2, "4 5")], "image_id string, n_words long, words string")
    sinks.write_frequency(freq, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).first()[0] == "im\t2\t4 5"


def test_end_to_end(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i // 5, i, (rng.normal(0, 0.05, 6) + np.eye(6)[i // 15 % 3]).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "image_id long, id long, embedding array<double>")
    queries = spark.createDataFrame([(0,), (4,)], ["image_id"])
    judgments = spark.createDataFrame([(0, 1, "good"), (0, 2, "ok"), (4, 3, "good")], "query long, doc long, grade string")
    for algorithm in ("hkm", "kmeans", "akm"):
        out = pipelines.run(df, pipelines.Config(algorithm, 2, 2, "euclidean", 4), "image_id", "id", queries, judgments)
        assert out["frequency"].agg(F.sum("n_words")).first()[0] == 90
        assert {r.query for r in out["ap"].collect()} == {0, 4}
    grid = pipelines.grid(("kmeans",), ((2, 2),), (1e-3,), ("first",))
    assert pipelines.sweep(df, grid, "image_id", "id", queries, judgments).count() == 1
    results = out["results"]
    h = spark.createDataFrame([(i, str(i % 3), 1) for i in range(18)], "key long, term string, tf long")
    assert pipelines.reranked_map(results, h, judgments, 0).first()["map"] == evaluate.mean_average_precision(out["ap"]).first()["map"]
    assert pipelines.reranked_map(results, h, judgments, 5).first()["n_queries"] == 2
    train, probe = pipelines.split_products(df, queries, queries.limit(0))
    assert train.count() == 10 and probe.count() == 0
    assert pipelines.combined(results, results, judgments).count() == 2


def png(width, height):
    """A picture with the column's number as its red value."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + b"".join(bytes([x % 256, 0, 9]) for x in range(width)) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_pictures_are_decoded_and_made_smaller(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "wide.png").write_bytes(png(40, 10))
    (tmp_path / "p" / "little.png").write_bytes(png(3, 4))
    (tmp_path / "p" / "broken.png").write_bytes(b"nothing")
    found = files.decoded(spark, str(tmp_path / "p"))
    assert sorted((r.image.width, r.image.height) for r in found.collect()) == [(3, 4), (40, 10)]
    out = {(r.width, r.height): bytes(r.data) for r in files.resized(found, 20).collect()}
    assert set(out) == {(3, 4), (20, 5)}
    assert list(out[20, 5][2::3][:20]) == list(range(0, 40, 2)) and len(out[20, 5]) == 20 * 5 * 3


def test_pictures_and_archives_go_out(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x.jpg").write_bytes(b"xyz")
    found = files.keyed_images(spark, str(tmp_path / "in"))
    changed = found.withColumns({"key": F.lit("a/y.jpg"), "whole": F.lit(False)})
    sinks.write_pictures(found.unionByName(changed), str(tmp_path / "s"))
    assert {r.key: bytes(r.value) for r in files.sequence_file(spark, str(tmp_path / "s")).collect()} == {"a/x.jpg": b"xyz", "a/y.jpg.broken": b"xyz"}
    for name in ("one", "two"):
        with tarfile.open(tmp_path / f"{name}.tar", "w") as tar:
            for i in range(3):
                info = tarfile.TarInfo(f"d/{name}{i}")
                info.size = 2
                tar.addfile(info, io.BytesIO(b"%02d" % i))
    put(tmp_path / "bad.tar", "nonsense")
    sinks.write_archives(files.tars(spark, str(tmp_path)), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.archive, r.name, bytes(r.content)) for r in rows) == sorted((n, f"d/{n}{i}", b"%02d" % i) for n in ("one", "two") for i in range(3))


def test_logs_reports_and_renames(spark, tmp_path):
    log = instrument.Phases("run")
    for _ in range(2):
        with log.phase("x"):
            pass
        log.append(spark, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 3
    put(tmp_path / "t" / "a.txt", "1\n2\n")
    put(tmp_path / "t" / "b.txt", "3\n")
    sinks.merge_text(spark, str(tmp_path / "t"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["1", "2", "3"]
    assert sinks.rename_files(spark, str(tmp_path / "t"), ".old") >= 2 and (tmp_path / "t" / "a.txt.old").exists()
    ap = spark.createDataFrame([("b", 1, 0.5), ("a", 2, 1.0)], "query string, n_relevant long, ap double")
    assert [tuple(r) for r in sinks.map_report(ap).collect()] == [("a", 1.0), ("b", 0.5), ("mean", 0.75)]
    assert [(r.folder, r.n_files) for r in files.folders(spark, str(tmp_path / "t")).collect()] == [("t", 2)]


def test_long_resource_logs_are_read_in_parts(spark, tmp_path):
    """A row's time may stand in a part of the file that another task reads."""
    body = "".join(f"TimeStamp: {1000 * i}\n" + "".join(f"a b c user{k} e f {k} g {k}M\n" for k in range(40)) for i in range(1, 30))
    put(tmp_path / "log" / "r.txt", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 600)
    try:
        found = files.resource_log(spark, str(tmp_path / "log")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.ts.timestamp(), r.user, r.mem) for r in found) == sorted((float(i), f"user{k}", k) for i in range(1, 30) for k in range(40))


def test_suffix_join_and_numbers(spark):
    names = spark.createDataFrame([("x/ab12",), ("zz",), (None,), ("12",), ("x/ab12",)], "name string").withColumn("key", F.lit("own"))
    keys = spark.createDataFrame([("12", 1), ("b12", 2), ("", 3), (None, 4), ("12", 0)], "tail string, n int")
    assert sorted((r.name, r.tail, r.n) for r in rank.suffix_join(names, keys, "name", "tail").collect()) == [("12", "12", 0), ("x/ab12", "b12", 2), ("x/ab12", "b12", 2)]
    assert rank.suffix_join(names, keys.limit(0), "name", "tail").count() == 0
    many = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r.pos == r.v for r in rank.numbered(many, "v").collect())
    assert rank.numbered(many.limit(0), "v").count() == 0


def test_stored_engine(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f"im{i // 5}", rng.normal(i // 25, 0.2, 6).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, image_id string, embedding array<double>")
    for config in (pipelines.Config("hkm", 2, 2), pipelines.Config("kmeans", 2, 2, metric="euclidean"), pipelines.Config("akm", 2, 2)):
        engine = stored.Engine.build(df, config, "image_id", "id")
        engine.write(spark, str(tmp_path / config.algorithm))
        again = stored.Engine.read(spark, str(tmp_path / config.algorithm))
        assert again.vocabulary.config == config
        expected = {(r.query, r.doc, r.score, r["rank"]) for r in engine.search(df, "image_id", 3).collect()}
        assert {(r.query, r.doc, r.score, r["rank"]) for r in again.search(df, "image_id", 3).collect()} == expected
        one = df.where("image_id = 'im7'")
        for _ in range(2):
            found = {("im7", r.doc, r.score, r["rank"]) for r in again.search_one(one, "im7", 3).collect()}
            assert found == {x for x in expected if x[0] == "im7"} and len(again._terms) == 1


def test_runs_over_boxes_folds_classes_and_files(spark, tmp_path):
    features = spark.createDataFrame([("a.jpg", 1.0, 1.0, [1.0, 0.0]), ("a.jpg", 9.0, 9.0, [0.0, 1.0]), ("b.jpg", 1.0, 1.0, [1.0, 0.1])], "image string, x double, y double, descriptor array<double>")
    v = pipelines.Vocabulary(pipelines.Config("kmeans", 2, 1), assign.Vocabulary(np.arange(2), np.eye(2)))
    freq = pipelines.frequency(features, v, "image", "descriptor")
    boxes = spark.createDataFrame([("q", "a.jpg", 0.0, 0.0, 2.0, 2.0)], "query string, image string, x1 double, y1 double, x2 double, y2 double")
    found = pipelines.search_boxes(features, boxes, v, freq, "image")
    assert {r.doc for r in found.collect()} == {"a.jpg", "b.jpg"}
    results = spark.createDataFrame([(0, "q", "d", 1), (1, "q", "x", 1)], "fold int, query string, doc string, rank long")
    expected = spark.createDataFrame([(0, "q", "d"), (1, "q", "d")], "fold int, query string, doc string")
    assert tuple(pipelines.folds(results, expected).first()) == (2, 0.5)
    tests = spark.createDataFrame([("a.jpg", "a")], "image string, class string")
    assert tuple(pipelines.class_precision(freq, tests, "image", 1).first()) == ("a", 1, 1.0)
    put(tmp_path / "grid.txt", "2 3\n4\n")
    assert [(c.algorithm, c.top_k, c.bot_k) for c in pipelines.file_grid(spark, str(tmp_path / "grid.txt"), "kmeans")] == [("kmeans", 2, 3), ("kmeans", 4, 1)]
    pictures = spark.createDataFrame([(f"k{i}", bytearray(bytes(range(i, i + 128)))) for i in range(4)], "key string, value binary")
    sinks.write_sequence_file(pictures, str(tmp_path / "seq"), "key", "value")
    asked = spark.createDataFrame([("k1",)], "image_id string")
    out = pipelines.run_sequence_file(spark, str(tmp_path / "seq"), extract.byte_histogram, pipelines.Config("kmeans", 2, 1), asked)
    assert out["results"].first()["query"] == "k1" and [r[1] for r in out["phases"].rows] == ["features", "vocabulary", "search"]
    log = pipelines.extract_all(spark, [str(tmp_path / "seq")] * 2, extract.byte_histogram, str(tmp_path / "f"))
    assert len(log.rows) == 2 and spark.read.parquet(str(tmp_path / "f")).count() == 16
    whole = extract.byte_descriptors(spark.read.parquet(str(tmp_path / "f")))
    assert all(x == int(x) for x in whole.first().descriptor)
    vocabularies, log = pipelines.build_all(out["features"].withColumn("o", F.struct("image_id", "x")), [pipelines.Config("kmeans", 2, 1)], "o", "descriptor")
    assert len(vocabularies) == len(log.rows) == 1
    put(tmp_path / "pics" / "z.jpg", "abc" * 50)
    assert extract.extract_folder(spark, str(tmp_path / "pics"), extract.byte_histogram).count() == 3

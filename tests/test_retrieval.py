import math

import pytest
from pyspark.sql import functions as F

from lodestack.functions.texts import tokens
from lodestack.operators import bow, evaluate, rank, retrieval


def lists(spark, **found):
    return spark.createDataFrame([("q", d, i + 1) for name, docs in found.items() for i, d in enumerate(docs)], "query string, doc string, rank long")


def test_frequency(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 2), ("a", 5), ("b", None)], "image_id string, word long")
    assert [tuple(r) for r in bow.frequency(rows).collect()] == [("a", 3, "2 5 5")]


def test_object_histogram(spark):
    rows = spark.createDataFrame([(1, "x y z"), (1, "x x y"), (2, None)], "o int, text string")
    assert {r.term: r.repeats for r in bow.object_histogram(rows, "o", tokens(F.col("text"))).collect()} == {"x": 2, "y": 1, "z": 1}


def test_incomplete_counts_none(spark):
    objects = spark.createDataFrame([(1,), (2,), (3,)], ["o"])
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], ["o", "m"])
    assert {tuple(r) for r in bow.incomplete(objects, members, "o", "m").collect()} == {(2, 1), (3, 0)}


def test_score(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "d"), (3, "e"), (4, ""), (5, None)], "id int, text string")
    index = retrieval.Index.build(docs, "id", tokens(F.col("text")))
    asked = spark.createDataFrame([("q", "a", 1), ("q", "b", 1), ("q", "zz", 2)], "query string, term string, qtf long")
    found = retrieval.search(index, asked, 5).collect()
    ia, ib = 1 + math.log(4 / 3), 1 + math.log(4 / 2)
    assert [(r.doc, r.rank) for r in found] == [(0, 1), (1, 2)]
    assert found[0].score == pytest.approx(2 / 4 * (ia**2 + ib**2) / math.sqrt(2), abs=1e-6)
    assert found[1].score == pytest.approx(1 / 4 * ia**2 / math.sqrt(2), abs=1e-6)


def test_alike_documents_are_scored_once(spark, monkeypatch):
    """Many queries over few words: the results of ``search``, from pairs of classes."""
    rows = [(d, "abcd"[(d * d + j * (d % 7)) % 4]) for d in range(120) for j in range(1 + d % 3)]
    docs = spark.createDataFrame(rows, "doc long, term string").groupBy("doc").agg(F.concat_ws(" ", F.collect_list("term")).alias("text"))
    index = retrieval.Index.build(docs, "doc", tokens(F.col("text"))).saved()
    asked = index.postings.select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf"))
    asked = asked.unionByName(spark.createDataFrame([(500, "a", 1), (500, "zz", 2), (501, "zz", 1), (502, None, 1), (502, "b", 1), (None, "a", 1)], "query long, term string, qtf long"))
    expected = {tuple(r) for r in retrieval.search(index, asked, 4).collect()}
    scored, made = retrieval._scored, []

    def counted(*given):
        out = scored(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "_scored", counted)
    found = retrieval.search_alike(index, asked, 4).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    kinds = len({tuple(sorted(r.text.split())) for r in docs.collect()})
    assert made[0] <= kinds * (kinds + 3) < 120 * 120 / 8


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b"), (1, "a")], "id int, text string")
    retrieval.Index.build(docs, "id", tokens(F.col("text"))).write(str(tmp_path))
    assert {tuple(r) for r in retrieval.Index.read(spark, str(tmp_path)).terms.collect()} == {("a", 2), ("b", 1)}
    assert retrieval.without(docs, docs.where("id = 0"), "id").count() == 1


@pytest.mark.parametrize(
    "tw, vw, weight, expected",
    [
        ("AB", "BC", 0.6, {"B": 0.6, "A": 0.8, "C": 1.6}),
        ("ADB", "BCE", 0.25, {"B": 0.5, "C": 1.5, "A": 2.25, "E": 2.5, "D": 3.25}),
    ],
)
def test_fusion(spark, tw, vw, weight, expected):
    found = rank.fuse(lists(spark, tw=tw), lists(spark, vw=vw), weight).orderBy("rank").collect()
    assert {r.doc: r.fused for r in found} == pytest.approx(expected)
    assert [r.doc for r in found] == sorted(expected, key=expected.get)


def test_average_precision_skips_junk(spark):
    results = lists(spark, r="ajbc")
    judgments = spark.createDataFrame([("q", "a", "good"), ("q", "c", "ok"), ("q", "j", "junk")], ["query", "doc", "grade"])
    assert evaluate.average_precision(results, judgments).first()["ap"] == 0.833333
    perfect = judgments.where("grade <> 'junk'")
    assert evaluate.average_precision(lists(spark, r="acb"), perfect).first()["ap"] == 1.0
    assert evaluate.average_precision(lists(spark, r="x"), perfect).first()["ap"] == 0.0


def test_precision_recall_f1(spark):
    judgments = spark.createDataFrame([("q", "a", "good"), ("q", "z", "ok")], ["query", "doc", "grade"])
    marked = evaluate.judged(lists(spark, r="ab"), judgments)
    assert tuple(evaluate.precision_recall_f1(marked, evaluate.relevant_counts(judgments), 5).first()) == ("q", 0.5, 0.5, 0.5)
    none = evaluate.judged(lists(spark, r="b"), judgments)
    assert tuple(evaluate.precision_recall_f1(none, evaluate.relevant_counts(judgments), 5).first()) == ("q", 0.0, 0.0, None)


@pytest.mark.parametrize("docs, hit", [("abcde", 1), ("xabcde", 0)])
def test_hit_at_five(spark, docs, hit):
    expected = spark.createDataFrame([("q", "e")], ["query", "doc"])
    hits = evaluate.hit_at(lists(spark, r=docs), expected)
    assert hits.first()["hit"] == hit
    assert evaluate.hit_at(lists(spark, r=docs), expected, 5, expected).first()["hit"] == -1
    assert tuple(evaluate.accuracy(hits).first()) == (1, float(hit))


def test_positional_join(spark):
    many = spark.createDataFrame([(i, f"p{i}") for i in range(6)], ["pos", "probe"])
    one = spark.createDataFrame([(0, "g0"), (1, "g1")], ["pos", "gallery"])
    assert {r.pos: r.gallery for r in rank.positional_join(many, one).collect()} == {i: f"g{i // 3}" for i in range(6)}


def test_size_prefixes(spark):
    files = spark.createDataFrame([(i, 10) for i in range(100)], ["id", "size"])
    found = {(r.id, r.budget) for r in rank.size_prefixes(files, [0, 95, 10_000], "size", "id", 8).collect()}
    assert found == {(0, 0)} | {(i, 95) for i in range(10)} | {(i, 10_000) for i in range(100)}


def test_rerank_keeps_the_tail(spark):
    distances = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.1), ("q", "c", 0.0)], ["query", "doc", "distance"])
    found = rank.rerank_prefix(lists(spark, r="abcd"), distances, 2).orderBy("rank").collect()
    assert [r.doc for r in found] == ["b", "a", "c", "d"]
    found = rank.rerank_prefix(lists(spark, r="abcd"), distances, 0).orderBy("rank").collect()
    assert [r.doc for r in found] == ["a", "b", "c", "d"]


def test_histogram_distance(spark):
    a = spark.createDataFrame([("q", "x", 3), ("q", "y", 4)], "query string, term string, tf long")
    b = spark.createDataFrame([("d", "x", 3), ("e", "z", 5)], "doc string, term string, tf long")
    pairs = spark.createDataFrame([("q", "d"), ("q", "e"), ("q", "none")], ["query", "doc"])
    got = lambda s, n: {r.doc: r.distance for r in rank.histogram_distance(pairs, a, b, s, n).collect()}
    assert got("cosine", "raw") == pytest.approx({"d": -0.6, "e": 0.0, "none": 0.0})
    assert got("l1", "raw") == pytest.approx({"d": 4.0, "e": 12.0, "none": 7.0})
    assert got("l2", "raw") == pytest.approx({"d": 4.0, "e": 50**0.5, "none": 5.0}, abs=1e-6)
    assert got("l2", "l2")["d"] == pytest.approx((0.4**2 + 0.8**2) ** 0.5, abs=1e-6)


def test_oracle_weight(spark):
    ap = lambda x: spark.createDataFrame([("q", x)], ["query", "ap"])
    assert rank.oracle_weight(ap(0.5), ap(0.5)).first()["w"] == pytest.approx(0.6)
    assert rank.oracle_weight(ap(0.0), ap(0.0)).first()["w"] == 0.5

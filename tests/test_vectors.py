import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import texts
from lodestack.functions import vectors as V
from lodestack.operators import ann, assign, cluster


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], names).select(column.alias("x")).first()["x"]


def test_quantize_truncates(spark):
    assert one(spark, V.quantize_bytes(F.col("v")), v=[-2.0, 1.0, 0.5]) == [-127, 63, 31]
    assert one(spark, V.quantize_bytes(F.col("v")), v=[0.0, 0.0]) == [0, 0]


def test_zero_vectors_give_null(spark):
    assert one(spark, V.l2_normalize(F.col("v")), v=[0.0, 0.0]) is None
    assert one(spark, V.cosine_similarity(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) is None
    assert one(spark, V.l2_normalize(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]


def test_parsers(spark):
    assert one(spark, V.parse_sparse(F.col("t"), 4), t="1:2.5,3:-1") == [0.0, 2.5, 0.0, -1.0]
    assert one(spark, V.parse_dense(F.col("t")), t="1.0, 2") == [1.0, 2.0]
    f = one(spark, texts.feature_fields(F.col("t"), 3), t=" 1.5 0.2 10 20 7 8 9")
    assert (f.scale, f.orientation, f.x, f.y, f.descriptor) == (1.5, 0.2, 10.0, 20.0, [7.0, 8.0, 9.0])


def test_box_is_inclusive(spark):
    rows = spark.createDataFrame([(2.0, 2.0), (2.1, 1.0), (0.0, 0.0)], ["x", "y"])
    assert [(r.x, r.y) for r in rows.where(texts.inside(F.col("x"), F.col("y"), 0, 0, 2, 2)).collect()] == [(2.0, 2.0), (0.0, 0.0)]


def test_resize_and_paths(spark):
    assert one(spark, texts.fit_ratio(F.col("w"), F.col("h")), w=4096, h=1024) == 0.5
    assert one(spark, texts.fit_ratio(F.col("w"), F.col("h")), w=100, h=100) == 1.0
    assert one(spark, texts.synset(F.col("p")), p="a/b/n01_22.jpg") == "n01"
    assert one(spark, texts.parent(F.col("p")), p="a/b/c.jpg") == "b"
    assert one(spark, texts.parent(F.col("p")), p="c.jpg") is None
    assert one(spark, texts.is_image(F.col("p")), p="x.JPG") and not one(spark, texts.is_image(F.col("p")), p="x.txt")


def test_nearest_ties_zero_and_bad_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 2.0]), (5, [None, 1.0])], "id int, embedding array<double>")
    v = assign.Vocabulary(np.array([0, 1]), np.eye(2))
    assert {r.id: r.cid for r in assign.assign(rows, v).collect()} == {0: 0, 1: None, 2: None, 3: None, 4: 1, 5: None}
    v = assign.Vocabulary(np.array([0, 1]), np.eye(2), "euclidean")
    assert {r.id: r.cid for r in assign.assign(rows, v).collect()} == {0: 0, 1: 0, 2: None, 3: None, 4: 1, 5: None}


def test_two_level_word(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0])], "id int, embedding array<double>")
    top = assign.Vocabulary(np.array([0, 3]), np.eye(2))
    out = assign.assign_two_level(rows, top, {3: assign.Vocabulary(np.array([7]), np.array([[0.0, 1.0]]))}, 10)
    assert out.first()["word"] == 37
    assert assign.assign_two_level(rows, top, {}, 10).first()["word"] is None


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(90, 6)), rng.normal(size=(70, 6))
    c[40] = c[3]
    x[0] = 0
    for metric in ("cosine", "euclidean"):
        v = assign.Vocabulary(np.arange(70), c, metric)
        monkeypatch.setattr(assign, "ROWS", 1000)
        monkeypatch.setattr(assign, "COLUMNS", 1000)
        best, value = v.nearest(x)
        assert best[0] == -1 if metric == "cosine" else best[0] >= 0
        assert 40 not in best
        exact = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert metric == "cosine" or best.tolist() == exact.tolist()
        monkeypatch.setattr(assign, "ROWS", 7)
        monkeypatch.setattr(assign, "COLUMNS", 9)
        again, near = v.nearest(x)
        assert again.tolist() == best.tolist() and np.allclose(near, value, equal_nan=True)


def test_two_level_by_a_table(spark, monkeypatch):
    """A table of bottom centroids gives what broadcast ones give, also if a top word's vectors are dealt to many parts."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    rows = [(i, v.tolist(), "own") for i, v in enumerate(x)] + [(900, None, "own"), (901, [0.0] * 4, "own"), (902, [1.0], "own")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, m string")
    top = assign.Vocabulary(np.arange(3), rng.normal(size=(3, 4)))
    bottoms = {t: assign.Vocabulary(np.arange(5), rng.normal(size=(5, 4))) for t in (0, 1)}
    expected = {r.id: (r.top_id, r.bot_id, r.word) for r in assign.assign_two_level(df, top, bottoms, 5).collect()}
    for group in (20, 10**6):
        monkeypatch.setattr(assign, "GROUP", group)
        out = assign.assign_two_level(df, top, cluster.bottom_table(spark, bottoms), 5)
        assert out.columns == ["id", "embedding", "m", "top_id", "bot_id", "word"]
        assert {r.id: (r.top_id, r.bot_id, r.word) for r in out.collect()} == expected
    monkeypatch.setattr(assign, "MODEL_NUMBERS", 10)
    for model in (bottoms, cluster.bottom_table(spark, bottoms)):
        with pytest.raises(ValueError):
            assign.assign_two_level(df, top, model, 5)


def test_duplicate_centroids_are_an_error(spark):
    with pytest.raises(ValueError):
        assign.Vocabulary.collect(spark.createDataFrame([(0, [1.0]), (0, [2.0])], "cid int, centroid array<double>"))


def test_rss_and_carry_over(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],)], "embedding array<double>").withColumn("_ls_top", F.lit(0).cast("long"))
    start = {0: assign.Vocabulary(np.array([0, 1]), np.array([[1.0, 0.0], [50.0, 50.0]]), "euclidean")}
    found = cluster.sums(rows, start).collect()
    assert [(r.cid, r.n, r["mean"], r.rss) for r in found] == [(0, 2, [1.0, 0.0], 2.0)]
    result = cluster.lloyd(rows, start)
    assert result.converged and result.vocabularies[0].matrix.tolist() == [[1.0, 0.0], [50.0, 50.0]]
    old = spark.createDataFrame([(0, [9.0]), (1, [8.0])], "cid int, centroid array<double>")
    new = spark.createDataFrame([(0, [1.0])], "cid int, centroid array<double>")
    assert {r.cid: r.centroid for r in cluster.carry_over(old, new).collect()} == {0: [1.0], 1: [8.0]}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 8)) for c in range(5)])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


def test_rss_never_rises(cloud):
    _, df = cloud
    result = cluster.kmeans(df, cluster.first_k(df, 5, "id"), "euclidean")
    assert all(b <= a + 1e-9 for a, b in zip(result.rss, result.rss[1:]))


def test_hierarchical_and_seeds(cloud):
    _, df = cloud
    top, bottoms = cluster.hierarchical(df, 3, 2, "id", "euclidean")
    v = cluster.merged(top, bottoms, 2)
    assert len(set(v.ids.tolist())) == len(v.ids) == 6
    assert cluster.random_k(df, 7, 1).count() == cluster.bernoulli_k(df, 7, 1).count() == 7
    with pytest.raises(ValueError):
        cluster.bernoulli_k(df, 10_000, 1)


def test_forest_recall_at_its_standing_share(cloud):
    """At the standing share of 0.05, over enough points that the share and not the leaves bounds the search."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    points = np.concatenate([rng.normal(c, 0.15, (100, 16)) for c in centres])
    found = ann.report(points, points[:300] + rng.normal(0, 0.05, (300, 16)))
    assert found["precision"] >= 0.9 and found["compared"] <= 0.1, found
    x, df = cloud
    v = assign.Vocabulary(np.arange(50), x[:50], "euclidean")
    exact = {r.id: r.cid for r in assign.assign(df, v).collect()}
    near = {r.id: r.cid for r in ann.forest_assign(df, v).collect()}
    assert sum(exact[i] == near[i] for i in exact) >= 0.8 * len(exact)
    assert len(ann.approximate_kmeans(df, cluster.first_k(df, 5, "id"), 5).rss) >= 1


def test_byte_vocabulary(cloud):
    _, df = cloud
    bytes_ = df.select("id", V.quantize_bytes(F.col("embedding")).alias("embedding"))
    found = ann.approximate_kmeans(bytes_, cluster.first_k(bytes_, 5, "id"), whole=True)
    m = found.vocabularies[0].matrix
    assert (m == np.trunc(m)).all() and abs(m).max() <= 127 and found.iterations >= 1


def test_several_problems_with_a_forest_each(spark, cloud):
    x, _ = cloud
    rows = spark.createDataFrame([(v.tolist(), i % 2) for i, v in enumerate(x)], "embedding array<double>, _ls_top long")
    start = {t: assign.Vocabulary(np.arange(5), x[t : t + 10 : 2] + 0.0, "euclidean") for t in (0, 1)}
    exact = cluster.lloyd(rows, start, iterations=2)
    near = cluster.lloyd(rows, start, iterations=2, search=lambda v: ann._Finder(v, 0, 1.0))
    for t in (0, 1):
        assert np.allclose(exact.vocabularies[t].matrix, near.vocabularies[t].matrix)


def test_stall_rule():
    assert not cluster._stalled([1.0, 1.0], 0.1)
    assert cluster._stalled([1.0, 1.0, 1.0], 0.001)
    assert not cluster._stalled([4.0, 2.0, 1.0], 0.001)


def test_empty_input(spark):
    rows = spark.createDataFrame([], "id long, embedding array<double>")
    assert assign.assign(rows, assign.Vocabulary(np.array([0]), np.array([[1.0]]))).count() == 0
    assert assign.assign(spark.createDataFrame([([1.0],)], "embedding array<double>"), assign.Vocabulary(np.array([]), np.empty((0, 1)))).first()["cid"] is None

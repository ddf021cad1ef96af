import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import vectors as v
from quiverlake.operators import clusters, graphs, hashing, knn, labels, pages, quantization

POINTS = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [6.0, 8.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0])]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id long, vec array<double>")


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(0, [1.0, 1.0])], "id long, vec array<double>")


def test_distances(points, one):
    q = F.lit([1.0, 1.0])
    got = {r[0]: tuple(r)[1:] for r in points.select("id", v.l2(F.col("vec"), q), v.dot(F.col("vec"), q), v.cosine(F.col("vec"), q)).collect()}
    assert [got[i][0] for i in range(1, 6)] == [2, 13, 74, 1, 2] and [got[i][1] for i in range(1, 6)] == [0, 7, 14, 1, 2]
    assert math.isnan(got[1][2]) and abs(got[2][2] - 0.010051) < 1e-6 and abs(got[4][2] - 0.292893) < 1e-6
    with pytest.raises(ValueError):
        v.distance("ip", q, q, integers=True)
    with pytest.raises(ValueError):
        v.distance("l3", q, q)


def test_knn_ties_ranges_and_small_sets(points, one):
    ids = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert ids(knn.knn(points, one, 3)) == [4, 1, 5] and ids(knn.knn(points, one, 3, "ip")) == [3, 2, 5]
    assert len(knn.knn(points, one, 99).collect()) == 5
    assert sorted(r["id"] for r in knn.within_range(points, one, 2.0).collect()) == [1, 4, 5]
    assert knn.knn(points.limit(0), one, 3).count() == 0 and knn.knn(points, one.limit(0), 3).count() == 0


def test_query_blocks(points, monkeypatch):
    want = sorted(map(tuple, knn.knn(points, points, 2).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, knn.knn(points, points, 2).collect())) == want


@pytest.mark.parametrize(("dist", "found", "want"), [([0, 1, 2, 2], [1, 2, 4], 100), ([0, 1, 2, 3], [1, 2, 4], 66.667), ([0, 1, 2, 2], [1, 1, 4], 66.667)])
def test_recall(spark, dist, found, want):
    truth = spark.createDataFrame([(0, i + 1, i + 1, float(x)) for i, x in enumerate(dist)], "qid long, rank int, id long, dist double")
    result = spark.createDataFrame([(0, i) for i in found], "qid long, id long")
    assert abs(knn.recall(truth, result, 3).first()[0] - want) < 1e-3


def test_quantise_and_ball(spark, points):
    row = spark.range(1).select(v.to_int8(F.lit([-1.0, -0.5, 0.3, 1.0]), 0.0, 2.0), F.size(v.hamming_ball(F.lit(5).cast("long"), 32, 1)), F.size(v.hamming_ball(F.lit(5).cast("long"), 32, 2))).first()
    assert row[0] == [-127, -63, 38, 127] and row[1] == 33 and row[2] == 529
    assert clusters.medoid(points).first()["id"] == 2
    assert np.allclose(clusters.mean_vector(points), [2.0, 2.8])


def test_labels(spark):
    lines = spark.createDataFrame([(0, "a,b"), (1, "b"), (2, "u"), (3, "c,a\tx"), (4, None)], "id long, line string")
    points = labels.parse(lines)
    assert {r["label"]: r["code"] for r in labels.encode(points, "u").collect()} == {"u": 0, "a": 2, "b": 3, "c": 4}
    assert {r["label"]: r["code"] for r in labels.encode(points).collect()} == {"a": 1, "b": 2, "u": 3, "c": 4}
    assert sorted(r["id"] for r in labels.inverted(points, "u").where("label = 'c'").collect()) == [2, 3]
    out = sorted((r["id"], r["origin"], r["labels"]) for r in labels.broken_up(points.where("id < 4"), 1, 4).collect())
    assert out == [(0, 0, ["a"]), (1, 1, ["b"]), (2, 2, ["u"]), (3, 3, ["c"]), (4, 0, ["b"]), (5, 3, ["a"])]
    wanted = spark.createDataFrame([(0, "zz")], "qid long, label string")
    assert labels.lookup(wanted, labels.encode(points, "u"), "u").first()["code"] == 0
    with pytest.raises(Exception, match="unknown label"):
        labels.lookup(wanted, labels.encode(points)).collect()


def test_robust_prune_on_a_line():
    x = np.array([[0.0], [1.0], [2.0], [-1.0]])
    assert graphs.robust_prune(x, 0, [1, 2, 3], 2) == [1, 3]


def test_graph_invariants_and_recall(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(a) for a in r], [["a", "b"][i % 2]], 0) for i, r in enumerate(rng.standard_normal((400, 16)))]
    base = spark.createDataFrame(rows, "id long, vec array<double>, labels array<string>, shard long")
    edges = graphs.build(base, 12, 30)
    found = edges.collect()
    assert len(found) == 400 and all(len(r["nbrs"]) <= 12 and r["src"] not in r["nbrs"] and len(set(r["nbrs"])) == len(r["nbrs"]) for r in found)
    assert sum(r["is_start"] for r in found) == 1
    queries = base.where("id < 30").select("id", "vec")
    truth = knn.knn(base, queries, 10)
    assert knn.recall(truth, graphs.search(base, edges, queries, 10, 60), 10).first()[0] >= 95
    fast, plain = (graphs.search(base, edges, queries, 10, 60, metric=m).orderBy("qid", "rank").collect() for m in ("fast_l2", "l2"))
    assert [(r["qid"], r["id"]) for r in fast] == [(r["qid"], r["id"]) for r in plain]
    labelled = graphs.search(base, edges, queries, 5, 60, keep_label="a")
    assert all(r["id"] % 2 == 0 for r in labelled.collect())
    with pytest.raises(ValueError):
        graphs.search(base, edges, queries, 10, 5)
    built = pages.build(base, edges, 7, 40)
    members = [i for r in built.collect() for i in r["ids"]]
    assert sorted(members) == list(range(400))
    assert all(not set(r["nbrs"]) & set(r["ids"]) and len(r["nbrs"]) <= 40 for r in built.collect())
    assert knn.recall(truth, pages.search(built, queries, 10, 60), 10).first()[0] >= 95
    book = quantization.fit(base, 8, 32)
    assert knn.recall(truth, pages.search(built, queries, 10, 80, book=book), 10).first()[0] >= 90
    filtered = graphs.build_filtered(base, 12, 30)
    assert {s for r in filtered.collect() for s in r["starts_label"]} == {"a", "b"} and all(len(r["nbrs"]) <= 12 for r in filtered.collect())
    only_a = knn.knn_filtered(base, queries, 5, F.array_contains("labels", "a"))
    own = graphs.search(base, filtered.select("shard", "src", "nbrs", "is_start"), queries, 5, 60, keep_label="a")
    assert knn.recall(only_a, own, 5).first()[0] >= 95
    sewn = graphs.build_stitched(base, 10, 20, 16).collect()
    assert len(sewn) == 400 and all(len(r["nbrs"]) <= 16 and r["src"] not in r["nbrs"] for r in sewn)
    assert pages.search(built, queries, 10, 60, most_pages=1).count() <= 30 * 7


def test_training_lowers_errors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8)) * np.linspace(0.2, 3, 8)
    c1, _, first = clusters.kmeans(x, 16, rounds=1)
    _, _, last = clusters.kmeans(x, 16, rounds=12)
    assert last <= first
    plain = quantization.train(x, 4, 16)
    rotated = quantization.train_rotated(x, 4, 16, rounds=6)
    error = lambda b: ((x - (b.decode(b.encode(x)) if b.rotation is None else b.decode(b.encode(x)) @ b.rotation.T)) ** 2).sum()
    assert error(rotated) < error(plain) * 1.05
    assert np.allclose(rotated.rotation @ rotated.rotation.T, np.eye(8))


def test_buckets_and_sampling(spark):
    h = spark.createDataFrame([(i, i % 4 if i < 300 else 7) for i in range(320)], "id long, hash long")
    assert hashing.buckets(h, 255).groupBy("hash").count().agg(F.max("count")).first()[0] == 75
    small = hashing.sampled_buckets(h, 100, least=4)
    assert 100 <= small.count() <= 105 and small.where("hash = 7").count() == 20


def test_samples_are_bounded_and_do_not_depend_on_partitions(spark):
    points = spark.range(5000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    a, b = (clusters.sample_matrix(p, 200) for p in (points.repartition(7), points.coalesce(1)))
    assert a.shape == (200, 2) and (a == b).all() and len(clusters.sample_matrix(points, 10_000)) == 5000

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake import session
from quiverlake.index import Parameters, VectorIndex
from quiverlake.operators import knn
from quiverlake.sources import files, generators
from quiverlake.streaming import ingest


@pytest.mark.parametrize("kind", ["float", "int8", "uint8"])
@pytest.mark.parametrize("layout", ["bin", "vecs"])
def test_round_trips(spark, tmp_path, kind, layout):
    x = np.arange(60).reshape(12, 5) % 100
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    files.write(frame, str(tmp_path / "out"), layout, kind, parts=3)
    back = {r["id"]: [int(v) for v in r["vec"]] for r in files.read(spark, str(tmp_path / "out"), layout, kind).collect()}
    assert back == {i: r.tolist() for i, r in enumerate(x)}


def test_bin_source(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((25, 4)).astype("f4")
    (tmp_path / "a.bin").write_bytes(files.format_bin(x, "float"))
    spark.dataSource.register(files.BinSource)
    df = spark.read.format("quiver_bin").option("path", str(tmp_path / "a.bin")).option("rowsPerPartition", "7").load()
    assert df.rdd.getNumPartitions() == 4
    assert {r["id"]: r["vec"] for r in df.collect()} == {i: r.tolist() for i, r in enumerate(x)}
    with pytest.raises(ValueError):
        files.parse_bin(struct.pack("<ii", 3, 4) + b"12", "float")


def test_truth_graph_and_text(spark, tmp_path):
    ids, dist = np.array([[1, 2], [3, 4]]), np.array([[0.5, 1.5], [0.25, 2.0]])
    a, b = files.parse_truth(files.format_truth(ids, dist))
    assert (a == ids).all() and (b == dist).all() and files.parse_truth(files.format_truth(ids))[1] is None
    assert files.truth_frame(spark, files.format_truth(ids, dist)).count() == 4
    with pytest.raises(ValueError):
        files.parse_truth(files.format_truth(ids) + b"xy")
    body = struct.pack("<ii3I", 2, 3, 1, 2, 0)[:16] + np.array([7, 8, 9], "<u4").tobytes()
    assert [r.tolist() for r in files.parse_range_truth(struct.pack("<ii", 2, 3) + np.array([1, 2], "<u4").tobytes() + np.array([7, 8, 9], "<u4").tobytes())] == [[7], [8, 9]]
    assert len(body) == 28
    start, frozen, lists = files.parse_graph(files.format_graph([np.array([1, 2]), np.array([]), np.array([0])], 2))
    assert start == 2 and frozen == 0 and [r.tolist() for r in lists] == [[1, 2], [], [0]]
    frame = spark.createDataFrame([(0, [1.5, 2.0]), (1, [3.0, 4.25])], "id long, vec array<double>")
    files.write_tsv(frame, str(tmp_path / "t"))
    assert sorted(r["vec"] for r in files.read_tsv(spark, str(tmp_path / "t")).collect()) == [[1.5, 2.0], [3.0, 4.25]]
    tags = spark.createDataFrame([(0, 10)], "id long, tag long")
    with pytest.raises(ValueError):
        files.checked_tags(frame, tags)


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.vectors(spark, 50, 8, 2.0).repartition(5).orderBy("id").collect()
    assert a == generators.vectors(spark, 50, 8, 2.0).coalesce(1).orderBy("id").collect()
    assert all(abs(sum(v * v for v in r["vec"]) - 4) < 1e-9 for r in a)
    assert all(r["labels"] for r in generators.zipf_labels(spark, 50, 5).collect())
    assert generators.random_labels(spark, 50, 5).count() == generators.one_label(spark, 50, 5).count() == 50


def test_index_life_cycle(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r], [str(i % 3)]) for i, r in enumerate(rng.standard_normal((200, 8)))]
    table = spark.createDataFrame(rows, "id long, vec array<double>, labels array<string>")
    index = VectorIndex.build(table, label_col="labels", parameters=Parameters(degree=12, width=40, most_points=120))
    queries = table.where("id < 10").select("id", "vec")
    assert knn.recall(knn.knn(table, queries, 5), index.search(queries, 5), 5).first()[0] >= 95
    index, failed = index.delete(spark.createDataFrame([(0,), (1,), (999,)], "id long"))
    assert [r["id"] for r in failed.collect()] == [999]
    assert index.search(queries, 5).where("id in (0, 1)").count() == 0
    index, rejected = index.insert(spark.createDataFrame([(500, rows[0][1], ["0"]), (7, rows[1][1], ["0"])], "id long, vec array<double>, labels array<string>"))
    assert [r["id"] for r in rejected.collect()] == [7]
    assert index.search(queries.where("id = 0"), 1).first()["id"] == 500
    assert index.status() == {"active": 199, "indexed": 200, "fresh": 1, "deleted": 2}
    repaired = index.repair()
    assert repaired.edges.where("src in (0, 1) or array_contains(nbrs, 0L) or array_contains(nbrs, 1L)").count() == 0
    live = knn.knn(index.vectors(), queries, 5)
    assert knn.recall(live, repaired.search(queries, 5), 5).first()[0] >= 90
    whole, report = index.consolidate()
    assert report == {"before": 200, "deleted": 2, "added": 1, "after": 199}
    assert whole.status() == {"active": 199, "indexed": 199, "fresh": 0, "deleted": 0}
    whole.write(str(tmp_path / "index"))
    again = VectorIndex.read(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, again.search(queries, 3).collect())) == sorted(map(tuple, whole.search(queries, 3).collect()))
    with pytest.raises(ValueError):
        VectorIndex.build(table.union(table), label_col="labels")


def test_deleted_ids_come_again_and_many_deletions_hide_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r], [str(i % 3)]) for i, r in enumerate(rng.standard_normal((59, 6)))]
    schema = "id long, vec array<double>, labels array<string>"
    table = spark.createDataFrame(rows, schema)
    index = VectorIndex.build(table, label_col="labels", parameters=Parameters(degree=8, width=20))
    one = table.where("id = 10").select("id", "vec")
    gone, _ = index.delete(spark.createDataFrame([(10,)], "id long"))
    moved = spark.createDataFrame([(10, [9.0] * 6, ["0"])], schema)
    back, rejected = gone.insert(moved)
    assert rejected.count() == 0 and back.status() == {"active": 59, "indexed": 58, "fresh": 1, "deleted": 0}
    assert back.search(moved.select("id", "vec"), 1).first()["id"] == 10 and back.search(one, 1).first()["id"] != 10
    linked = back.link()
    assert linked.status() == {"active": 59, "indexed": 59, "fresh": 0, "deleted": 0}
    assert linked.search(moved.select("id", "vec"), 1).first()["id"] == 10
    few, _ = index.delete(table.where("id < 49").select("id"))
    found = few.search(one, 5, 20)
    live = knn.knn(table.where("id >= 49"), one, 5)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [r["id"] for r in live.orderBy("rank").collect()]
    assert few.search_with_vectors(one, 3).select("vec").count() == 3
    with pytest.raises(ValueError):
        index.search(one, 30, 20)


def test_labels_metrics_and_frozen_starts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) * (1 + i % 4) for v in r], ["u"] if i % 40 == 0 else [str(i % 3)]) for i, r in enumerate(rng.standard_normal((400, 12)))]
    table = spark.createDataFrame(rows, "id long, vec array<double>, labels array<string>")
    queries = table.where("id % 20 = 1").select("id", "vec")
    for metric in ("l2", "ip", "cosine"):
        index = VectorIndex.build(table, label_col="labels", parameters=Parameters(degree=16, width=60, most_points=250, metric=metric, frozen=3))
        assert index.edges.where("is_start").count() >= 6
        assert knn.recall(knn.knn(table, queries, 10, metric), index.search(queries, 10, 80), 10).first()[0] >= 90, metric
    index = VectorIndex.build(table, label_col="labels", parameters=Parameters(degree=16, width=40, universal_label="u", filtered=True))
    truth = knn.knn_filtered(table, queries, 10, F.arrays_overlap("labels", F.array(F.lit("2"), F.lit("u"))))
    assert knn.recall(truth, index.search(queries, 10, 40, "2"), 10).first()[0] >= 95
    with pytest.raises(ValueError):
        VectorIndex.build(table, label_col="labels", parameters=Parameters(degree=8, width=20)).search(queries, 5, label="none")


def test_graph_and_truth_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "src long, nbrs array<long>")
    files.write_graph(edges, str(tmp_path / "g"), 2)
    assert sorted((r["src"], r["nbrs"], r["is_start"]) for r in files.read_graph(spark, str(tmp_path / "g")).collect()) == [(0, [1, 2], False), (1, [], False), (2, [0], True)]
    found = spark.createDataFrame([(7, 1, 3, 0.5), (7, 2, 4, 0.75), (9, 1, 8, 1.0), (9, 2, 2, 2.0)], "qid long, rank int, id long, dist double")
    files.write_truth(found, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_truth(spark, str(tmp_path / "t")).collect())) == [(0, 1, 3, 0.5), (0, 2, 4, 0.75), (1, 1, 8, 1.0), (1, 2, 2, 2.0)]
    with pytest.raises(ValueError):
        files.write_truth(found.limit(3), str(tmp_path / "u"))


def test_blocks_of_one_file(spark, tmp_path):
    blocks = [(np.arange(6).reshape(2, 3), "float"), (np.array([[1, 2]]), "int8")]
    offsets = files.write_blocks(spark, str(tmp_path / "blocks"), blocks)
    body = files.content(spark, str(tmp_path / "blocks"))
    assert offsets == [0, 32] and all((files.parse_bin(body, kind, at) == x).all() for at, (x, kind) in zip(offsets, blocks))


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert session.shared_dir(Session()) == session.shared_dir(Session())


def test_change_stream(spark, tmp_path):
    schema = "id long, op string, vec array<double>, seq long"
    spark.createDataFrame([(1, "insert", [1.0], 1), (2, "insert", [2.0], 2), (1, "delete", None, 3)], schema).write.parquet(str(tmp_path / "in"))
    ingest.append_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert [(r["id"], r["vec"]) for r in ingest.current(spark, str(tmp_path / "log")).collect()] == [(2, [2.0])]

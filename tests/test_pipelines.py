import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import evaluate, knn, labels, pages
from quiverlake.plans import pipelines
from quiverlake.__main__ import main
from quiverlake.sources import files


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.standard_normal((300, 16)))], "id long, vec array<double>")


def test_page_index(spark, points, tmp_path):
    built = pipelines.build_page_index(points.withColumn("labels", F.array((F.col("id") % 3).cast("string"))), 0.1, 8, 8, most_points=200, width=40, bits=6)
    assert built.cached_share == 1.0 and built.cache == "all" and built.codes.count() == 300
    assert built.pages.select("shard").distinct().count() >= 2
    assert len({r["new"] for r in built.mapping.collect()}) == 300
    queries = points.where("id < 20")
    truth = knn.knn(points, queries, 10)
    assert knn.recall(truth, pages.search(built.pages, queries, 10, 80, book=built.book), 10).first()[0] >= 90
    assert built.buckets.count() == 300
    built.write(str(tmp_path / "pages"))
    again = pipelines.PageIndex.read(spark, str(tmp_path / "pages"))
    want = built.search(queries, 10, 80, radius=1)
    assert sorted(map(tuple, again.search(queries, 10, 80, radius=1).collect())) == sorted(map(tuple, want.collect()))
    assert knn.recall(truth, want, 10).first()[0] >= 80
    log = again.read_log(queries, 10, 80, most_pages=3)
    assert all(len(r["pages"]) <= 3 and r["hops"] <= 3 for r in log.collect())
    seen = {p for r in log.collect() for p in r["pages"]}
    members = {i for r in again.pages.where(F.col("page_id").isin(list(seen))).collect() for i in r["ids"]}
    assert {r["id"] for r in pages.results(log, 10).collect()} <= members
    assert pages.visits(log).agg(F.sum("n")).first()[0] == sum(len(r["pages"]) for r in log.collect())
    assert again.cache_pages(queries, 40, 0.1).count() == int(0.1 * again.pages.count())
    own = again.search(queries, 5, 80, keep_label="2").join(points.select("id"), "id")
    assert own.count() == 100 and all(r["id"] % 3 == 2 for r in own.collect())
    report = evaluate.search_report(lambda: again.read_log(queries, 10, 80), 20, truth)
    assert report["recall_10"] >= 90 and report["mean_ios"] >= 1 and report["p999_ios"] >= report["mean_ios"] and report["qps"] > 0
    with pytest.raises(ValueError):
        again.search(queries, 5, 80, keep_label="none")
    with pytest.raises(ValueError):
        pipelines.build_page_index(points, 0.01, 8, 8)


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_prepared_vectors_rank_like_the_metric(points, metric):
    q = points.where("id < 5")
    want = {r["qid"]: r["id"] for r in knn.knn(points, q, 1, metric).collect()}
    if metric == "ip":
        from pyspark.sql import functions as F

        from quiverlake.functions import vectors as v

        got = knn.knn(pipelines.prepared(points, "ip"), q.withColumn("vec", v.mips_query(F.col("vec"))), 1)
    else:
        got = knn.knn(pipelines.prepared(points, metric), pipelines.prepared(q, metric), 1)
    assert {r["qid"]: r["id"] for r in got.collect()} == want


def test_pages_of_codes_and_cached_neighbours(spark, points):
    built = pipelines.build_page_index(points, 0.1, 8, 8, width=40, bits=6, page_chunks=16)
    queries = points.where("id < 20")
    assert knn.recall(knn.knn(points, queries, 10), built.search(queries, 10, 80), 10).first()[0] >= 80
    split = pages.split_neighbours(built.pages, points.where("id % 3 = 0")).join(built.pages, ["shard", "page_id"]).collect()
    assert len(split) == built.pages.count()
    for r in split:
        assert r["cached"] == [i for i in r["nbrs"] if i % 3 == 0] and r["uncached"] == [i for i in r["nbrs"] if i % 3]
    assert pages.hops_for(32, 1000) == 2 and pages.hops_for(8, 1000) == 3 and pages.hops_for(8, 10**9) == 2


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_page_search_gives_the_metric(points, metric):
    queries = points.where("id % 30 = 1")
    index = pipelines.build_page_index(points, 0.1, 8, 8, metric, width=40, bits=6, coded_build=metric == "ip", rotated=metric == "cosine")
    truth, found = knn.knn(points, queries, 5, metric), index.search(queries, 5, 100)
    assert knn.recall(truth, found, 5).first()[0] >= 80
    dist = {(r["qid"], r["id"]): r["dist"] for r in knn.knn(points, queries, 300, metric).collect()}
    assert all(abs(r["dist"] - dist[r["qid"], r["id"]]) < 1e-4 for r in found.collect())


def test_dense_points_and_label_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0], ["a", "b", "c"]), (1, [2.0], ["a"])], "id long, vec array<double>, labels array<string>")
    got = sorted((r["id"], r["vec"][0], r["labels"]) for r in pipelines.broken_dense(rows, 2).collect())
    assert got == [(0, 1.0, ["a", "b"]), (1, 2.0, ["a"]), (2, 1.0, ["c"])]
    codes = labels.encode(rows)
    labels.write_map(codes, str(tmp_path / "map"))
    assert sorted(map(tuple, labels.read_map(spark, str(tmp_path / "map")).collect())) == sorted(map(tuple, codes.collect()))
    (tmp_path / "f.txt").write_text("a\n c \n")
    assert sorted(map(tuple, labels.read_filters(spark, str(tmp_path / "f.txt")).collect())) == [(0, "a"), (1, "c")]


def test_commands(spark, points, tmp_path, capsys):
    files.write(points, str(tmp_path / "base"), "bin", "float")
    files.write(points.where("id < 5"), str(tmp_path / "queries"), "bin", "float")
    at = lambda name: str(tmp_path / name)
    assert main(["ground_truth", "--base_file", at("base"), "--query_file", at("queries"), "--out", at("truth"), "--K", "3"]) == 0
    assert main(["build_index", "--data_path", at("base"), "--index", at("index"), "--R", "12", "--L", "30", "--most_points", "200"]) == 0
    search = ["search_index", "--index", at("index"), "--query_file", at("queries"), "--out", at("found"), "--K", "3", "--L", "40", "--truth", at("truth")]
    assert main([*search, "--fail_if_recall_below", "90"]) == 0 and main([*search, "--fail_if_recall_below", "101"]) == 1
    assert main(["recommend_degree", "--dim", "128", "--bytes", "1", "--points", "100000000", "--min_degree_per_node", "23", "--num_PQ_chunks", "20", "--mem_budget_in_GB", "3.6"]) == 0
    assert capsys.readouterr().out.strip().endswith("24")
    assert main(["hash_buckets", "--data_path", at("base"), "--out", at("buckets"), "--bits", "6"]) == 0
    assert main(["random_vectors", "--n", "10", "--dim", "4", "--out", at("random")]) == 0
    assert main(["convert", "--source", at("random"), "--source_format", "bin", "--out", at("random_vecs"), "--out_format", "vecs"]) == 0
    assert files.read(spark, at("random_vecs"), "vecs").count() == 10
    assert main(["random_labels", "--n", "300", "--labels", "4", "--kind", "one", "--out", at("labels")]) == 0
    assert main(["ground_truth", "--base_file", at("base"), "--query_file", at("queries"), "--out", at("of_label"), "--K", "3", "--label_file", at("labels"), "--filter_label", "2"]) == 0
    assert all(r["id"] % 4 == 1 for r in spark.read.parquet(at("of_label")).collect())
    assert main(["build_pages", "--data_path", at("base"), "--index", at("pages"), "--mem_budget_in_GB", "0.1", "--num_PQ_chunks", "8", "--min_degree_per_node", "8", "--L", "40"]) == 0
    capsys.readouterr()
    assert main(["search_pages", "--index", at("pages"), "--query_file", at("queries"), "--out", at("paged"), "--K", "3", "--L", "80", "--truth", at("truth"), "--fail_if_recall_below", "80"]) == 0
    assert {"qps", "mean_ios", "mean_hops", "recall"} <= set(json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    assert main(["update_index", "--index", at("index"), "--out", at("updated"), "--insert_file", at("queries"), "--first_id", "1000"]) == 0
    assert "'active': 305" in capsys.readouterr().out
    assert main(["train_codes", "--data_path", at("base"), "--out", at("codes"), "--num_PQ_chunks", "4", "--centres", "16"]) == 0
    assert main(["partition", "--data_path", at("base"), "--out", at("owner"), "--most_points", "250"]) == 0
    sizes = spark.read.parquet(at("owner")).groupBy("shard").count().collect()
    assert max(r["count"] for r in sizes) <= 250 and sum(r["count"] for r in sizes) == 600
    assert main(["merge_shards", "--data_path", at("base"), "--owner", at("owner"), "--out", at("merged"), "--R", "12", "--L", "30"]) == 0
    assert main(["bfs_levels", "--edges", at("merged")]) == 0 and main(["degrees", "--edges", at("merged")]) == 0
    assert main(["convert", "--source", at("base"), "--source_format", "bin", "--out", at("small"), "--out_format", "bin", "--out_type", "int8", "--scale", "8"]) == 0
    assert files.read(spark, at("small"), "bin", "int8").count() == 300
    for name in ("label_statistics --label_file labels", "analyse --data_path base", "recall --truth truth --result found --K 3", "random_slice --data_path base --out slice --share 0.3"):
        parts = [at(x) if x in ("labels", "base", "truth", "found", "slice") else x for x in name.split()]
        assert main(parts) == 0, name

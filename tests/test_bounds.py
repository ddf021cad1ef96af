"""Memory and work of single steps that larger tables need."""

import tracemalloc

import numpy as np
import pytest

from quiverlake.operators import clusters, graphs, hashing, knn


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_a_block_of_queries_is_compared_in_bounded_memory(metric):
    rng = np.random.default_rng(3)
    x, q, ids = rng.standard_normal((2048, 64)), rng.standard_normal((3000, 64)), np.arange(2048)
    assert peak_mb(lambda: knn.top_k(ids, x, q, 100, metric)) < 150


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "fast_l2"])
@pytest.mark.parametrize("kind", ["plain", "whole numbers", "zeros", "far from 0", "large", "copies"])
def test_batches_give_the_best_of_all_pairs(metric, kind):
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((700, 8)), rng.standard_normal((300, 8))
    if kind == "whole numbers":
        x, q = np.round(x), np.round(q)
    elif kind == "zeros":
        x[::7], q[::5] = 0, 0
    elif kind in ("far from 0", "large"):
        x, q = (x + 1e4, q + 1e4) if kind == "far from 0" else (x * 1e20, q * 1e20)
    elif kind == "copies":
        x[:600] = x[0]
        q[:50] = x[0]
    ids = rng.permutation(700)
    best, asked = knn.Best(300, 6), knn.Rows(q, metric, True)
    for at in range(0, 700, 90):
        best.scan(ids[at : at + 90], knn.Rows(x[at : at + 90], metric), asked)
    query, found, dist = best.merged()
    with np.errstate(all="ignore"):
        every = np.array([knn.exact(metric, x, np.broadcast_to(v, x.shape)) for v in q])
    order = np.array([np.lexsort((ids, row))[:6] for row in every])
    assert (query == np.repeat(np.arange(300), 6)).all() and (found == ids[order].ravel()).all()
    assert np.array_equal(dist, np.take_along_axis(every, order, 1).ravel(), equal_nan=True)


@pytest.mark.parametrize("block", [40, 4096])
def test_neighbour_graph_moves_blocks_and_equals_plain_code(spark, block):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((500, 4)), 1)
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None)], "id long, vec array<double>")
    graph = graphs.knn_graph(points, 5, block)
    # each point used to be a row of every pair of blocks
    assert "FlatMapGroupsInPandas" not in graph._jdf.queryExecution().toString()
    every = [knn.exact("l2", x, np.broadcast_to(v, x.shape)) for v in x]
    want = [(i, n + 1, j, float(every[i][j])) for i in range(500) for n, j in enumerate([int(j) for j in np.lexsort((np.arange(500), every[i])) if j != i][:5])]
    assert sorted(map(tuple, graph.collect())) == want


def test_two_blocks_meet_once_in_bounded_memory():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4096, 64))
    ids = np.arange(4096)

    def run():
        one, other = knn.Best(2048, 5), knn.Best(2048, 5)
        one.meet(ids[:2048], knn.Rows(x[:2048], "l2", True), ids[2048:], knn.Rows(x[2048:], "l2"), other, False)
        for best, at, rest in ((one, 0, 2048), (other, 2048, 0)):
            query, found, _ = knn.top_k(ids[rest : rest + 2048], x[rest : rest + 2048], x[at : at + 2048], 5, "l2")
            assert (best.merged()[0] == query).all() and (best.merged()[1] == found).all()

    assert peak_mb(run) < 120


def test_probe_gives_each_pair_once_without_grouping_pairs(spark, monkeypatch):
    monkeypatch.setattr(hashing, "PROBE_PART", 5)
    rng = np.random.default_rng(4)
    table = [(int(h), i) for i in range(60) for h in rng.integers(0, 16, 1 + i % 3)] + [(16 + 3, 99)]
    queries = [(q, int(h)) for q in range(12) for h in rng.integers(0, 16, 1 + q % 2)]
    found = hashing.probe(spark.createDataFrame(table, "hash long, id long"), spark.createDataFrame(queries, "qid long, hash long"), 4, 1)
    want = {(q, i) for q, own in queries for h, i in table if own == h or (own ^ h) in (1, 2, 4, 8)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("whole", [False, True])
def test_searches_of_many_queries_equal_single_ones(metric, whole):
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((300, 4)), rng.standard_normal((40, 4))
    if whole:
        x, q = np.round(2 * x), np.round(2 * q)
    nbrs, start = graphs.build_local(x, 8, 20, metric=metric)
    for wanted in (None, np.arange(300) % 3 == 1, np.arange(300) % 60 == 1):
        nodes, dist, hops = graphs.greedy_search_many(x, graphs.neighbour_table(nbrs), [start, 3], q, 25, metric, wanted)
        for at, v in enumerate(q):
            found, want, _, expanded = graphs.greedy_search(x, nbrs, [start, 3], v, 25, None, metric, wanted)
            free = dist[at] == np.inf
            assert nodes[at][~free].tolist() == found and hops[at] == expanded
            assert np.allclose(dist[at][~free], want, rtol=1e-12, atol=1e-12)


def test_clustering_holds_no_matrix_of_all_distances():
    x = np.random.default_rng(8).standard_normal((30_000, 8))
    assert peak_mb(lambda: clusters.kmeans(x, 300, 2)) < 40


def test_pruning_makes_no_pandas_group_of_each_node(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 4))
    lists = [sorted(rng.choice([j for j in range(60) if j != i], 9, replace=False).tolist()) for i in range(60)]
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    out = graphs.pruned(spark.createDataFrame(list(enumerate(lists)), "src long, nbrs array<long>"), points, 4)
    assert {r["src"]: r["nbrs"] for r in out.collect()} == {i: graphs.robust_prune(x, i, row, 4) for i, row in enumerate(lists)}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()

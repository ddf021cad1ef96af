"""Commands: ``python -m quiverlake <command> ...``. Vector files are ``bin`` files; tables are Parquet."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as v
from .index import Parameters, VectorIndex
from .operators import clusters, evaluate, graphs, hashing, knn, labels, pages, quantization
from .plans import pipelines, planner
from .session import local_session, ship_code
from .sources import files, generators

_commands: dict[str, tuple[tuple, Callable]] = {}
_METRICS = {"mips": "ip"}


def command(name: str, *options: tuple):
    """Registers ``run(spark, arguments)``; an option is (name, type, default), and one whose default is ... must be given."""

    def add(run):
        _commands[name] = (options, run)
        return run

    return add


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quiverlake")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (options, run) in _commands.items():
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for flag, kind, default in options:
            p.add_argument(f"--{flag}", type=kind, default=default, required=default is ...)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    run = _commands[a.command][1]
    spark = None if a.command in ("recommend_degree", "plan_pages") else ship_code(local_session())
    return int(run(spark, a) or 0)


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return files.read(spark, path, "bin", kind)


def _labelled(spark: SparkSession, points: DataFrame, path: str) -> DataFrame:
    return points.join(labels.parse(files.numbered_lines(spark, path)), "id")


def _stored(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


DATA = (("data_type", str, "float"), ("dist_fn", str, "l2"))
SOURCE = (("data_type", str, "float"), ("data_path", str, ...), ("out", str, ...))

# ---- truth and recall ----


@command("ground_truth", *DATA, ("base_file", str, ...), ("query_file", str, ...), ("out", str, ...), ("K", int, 10), ("label_file", str, ""), ("query_labels", str, ""), ("filter_label", str, ""), ("universal_label", str, ""), ("truth_file", str, ""))
def _truth(spark, a):
    """Exact nearest neighbours; of points with one label, or with each query's own."""
    base, queries, metric = _read(spark, a.base_file, a.data_type), _read(spark, a.query_file, a.data_type), _METRICS.get(a.dist_fn, a.dist_fn)
    if a.label_file:
        base = _labelled(spark, base, a.label_file)
        if a.query_labels:
            asked = labels.read_filters(spark, a.query_labels).withColumnRenamed("qid", "id")
            if a.universal_label:
                every = asked.select("label").distinct().agg(F.collect_set("label").alias("all"))
                base = base.join(F.broadcast(every)).withColumn("labels", F.when(F.array_contains("labels", a.universal_label), F.col("all")).otherwise(F.col("labels")))
            found = knn.knn_by_label(base, queries.join(asked, "id"), a.K, metric)
        else:
            keep = v.label_matches(F.col("labels"), F.array(F.lit(a.filter_label)), F.lit(a.universal_label) if a.universal_label else None)
            found = knn.knn_filtered(base, queries, a.K, keep, metric)
    else:
        found = knn.knn(base, queries, a.K, metric)
    _stored(found, a.out)
    if a.truth_file:
        files.write_truth(spark.read.parquet(a.out), a.truth_file)


@command("range_truth", *DATA, ("base_file", str, ...), ("query_file", str, ...), ("out", str, ...), ("radius", float, ...))
def _range(spark, a):
    """All points within a radius of each query."""
    _stored(knn.within_range(_read(spark, a.base_file, a.data_type), _read(spark, a.query_file, a.data_type), a.radius, _METRICS.get(a.dist_fn, a.dist_fn)), a.out)


@command("recall", ("truth", str, ...), ("result", str, ...), ("K", int, 10))
def _recall(spark, a):
    """Recall of a result against truth tables, ties counted."""
    print(round(knn.recall(spark.read.parquet(a.truth), spark.read.parquet(a.result).where(F.col("rank") <= a.K), a.K).first()[0], 4))


@command("simulate_recall", ("shards", int, ...), ("K", int, 10), ("shard_recall", float, ...))
def _simulate(spark, a):
    """Recall of a merged result from the recall of its shards."""
    print(round(evaluate.simulated_recall(spark, a.shards, a.K, a.shard_recall).first()[0], 4))


# ---- indexes in the vector's order ----


@command("build_index", *DATA, ("data_path", str, ...), ("index", str, ...), ("R", int, 64), ("L", int, 100), ("alpha", float, 1.2), ("most_points", int, graphs.SHARD_POINTS), ("label_file", str, ""), ("universal_label", str, ""), ("frozen", int, 0))
def _build(spark, a):
    """A graph index, with label starts where labels are given."""
    points, label_col = _read(spark, a.data_path, a.data_type), None
    if a.label_file:
        points, label_col = _labelled(spark, points, a.label_file), "labels"
    p = Parameters(a.R, a.L, a.alpha, a.most_points, 1, _METRICS.get(a.dist_fn, a.dist_fn), 1, a.universal_label or None, bool(a.label_file), a.frozen)
    VectorIndex.build(points, label_col=label_col, parameters=p).write(a.index)


@command("search_index", ("data_type", str, "float"), ("index", str, ...), ("query_file", str, ...), ("out", str, ...), ("K", int, 10), ("L", int, 100), ("filter_label", str, ""), ("truth", str, ""), ("fail_if_recall_below", float, 0.0))
def _search(spark, a):
    """Searches an index; its recall where truth is given."""
    _stored(VectorIndex.read(spark, a.index).search(_read(spark, a.query_file, a.data_type), a.K, a.L, a.filter_label or None), a.out)
    if a.truth:
        rows = evaluate.report(spark.read.parquet(a.truth), spark.read.parquet(a.out), (a.K,)).collect()
        print({r["k"]: round(r["recall"], 4) for r in rows})
        return int(rows[0]["recall"] < a.fail_if_recall_below)
    return 0


@command("update_index", ("data_type", str, "float"), ("index", str, ...), ("out", str, ...), ("insert_file", str, ""), ("first_id", int, 0), ("delete_ids", str, ""), ("mode", str, "link"))
def _update(spark, a):
    """Deletes ids (one a line) and inserts vectors, then links, repairs or consolidates (mode)."""
    index = VectorIndex.read(spark, a.index)
    if a.delete_ids:
        index, failed = index.delete(spark.read.text(a.delete_ids).where("trim(value) <> ''").select(F.trim("value").cast("long").alias("id")))
        print({"not_deleted": failed.count()})
    if a.insert_file:
        new = _read(spark, a.insert_file, a.data_type).select((F.col("id") + a.first_id).alias("id"), "vec", F.array().cast("array<string>").alias("labels"))
        index, rejected = index.insert(new)
        print({"rejected": rejected.count()})
    if a.mode == "consolidate":
        index, report = index.consolidate()
        print(report)
    else:
        index = index.link() if a.mode == "link" else index.repair()
    print(index.status())
    index.write(a.out)


@command("build_stitched", ("data_type", str, "float"), ("data_path", str, ...), ("label_file", str, ...), ("out", str, ...), ("R", int, 32), ("L", int, 100), ("stitched_R", int, 64), ("alpha", float, 1.2))
def _stitched(spark, a):
    """A graph for each label, stitched together and pruned."""
    _stored(graphs.build_stitched(_labelled(spark, _read(spark, a.data_path, a.data_type), a.label_file), a.R, a.L, a.stitched_R, a.alpha), a.out)


@command("bfs_levels", ("edges", str, ...), ("start", int, 0))
def _bfs(spark, a):
    """Nodes first reached at each level from a start node of an edge table (src, nbrs)."""
    pairs = spark.read.parquet(a.edges).select("src", F.explode("nbrs").alias("dst"))
    print({r["level"]: r["n"] for r in graphs.bfs_levels(pairs, a.start).orderBy("level").collect()})


@command("degrees", ("edges", str, ...))
def _degrees(spark, a):
    """Nodes, largest, smallest and mean degree of an edge table."""
    print(graphs.degrees(spark.read.parquet(a.edges)).first().asDict())


# ---- pages ----


@command("build_pages", *DATA, ("data_path", str, ...), ("index", str, ...), ("mem_budget_in_GB", float, ...), ("num_PQ_chunks", int, ...), ("min_degree_per_node", int, ...), ("L", int, 100), ("alpha", float, 1.2), ("label_file", str, ""), ("rotated", int, 0), ("coded_build", int, 0))
def _build_pages(spark, a):
    """A page index under a memory budget."""
    points = _read(spark, a.data_path, a.data_type)
    points = _labelled(spark, points, a.label_file) if a.label_file else points
    index = pipelines.build_page_index(points, a.mem_budget_in_GB, a.num_PQ_chunks, a.min_degree_per_node, _METRICS.get(a.dist_fn, a.dist_fn), width=a.L, alpha=a.alpha, rotated=bool(a.rotated), coded_build=bool(a.coded_build))
    index.write(a.index)


@command("search_pages", ("data_type", str, "float"), ("index", str, ...), ("query_file", str, ...), ("out", str, ...), ("K", int, 10), ("L", int, 100), ("W", int, 4), ("io_limit", int, 0), ("radius", int, -1), ("filter_label", str, ""), ("truth", str, ""), ("fail_if_recall_below", float, 0.0))
def _search_pages(spark, a):
    """Searches a page index and reports latency, pages read, hops and recall."""
    index, queries = pipelines.PageIndex.read(spark, a.index), _read(spark, a.query_file, a.data_type)
    options = {"beam": a.W, "most_pages": a.io_limit or None, "radius": a.radius if a.radius >= 0 else None, "keep_label": a.filter_label or None}
    _stored(index.search(queries, a.K, a.L, **options), a.out)
    report = evaluate.search_report(lambda: index.read_log(queries, a.K, a.L, **options), queries.count())
    if a.truth:
        report["recall"] = knn.recall(spark.read.parquet(a.truth), spark.read.parquet(a.out), a.K).first()[0]
    print(json.dumps({k: round(float(x), 4) for k, x in report.items()}))
    return int(report.get("recall", 100.0) < a.fail_if_recall_below)


@command("cache_pages", ("data_type", str, "float"), ("index", str, ...), ("sample_file", str, ...), ("out", str, ...), ("L", int, 100), ("pages", int, 0))
def _cache(spark, a):
    """The pages that a sample of queries reads most."""
    index = pipelines.PageIndex.read(spark, a.index)
    _stored(pages.visits(index.read_log(_read(spark, a.sample_file, a.data_type), 1, a.L), a.pages or None), a.out)


@command("recommend_degree", ("dim", int, ...), ("bytes", int, 4), ("points", int, ...), ("min_degree_per_node", int, ...), ("num_PQ_chunks", int, ...), ("mem_budget_in_GB", float, ...))
def _recommend(_, a):
    """The graph degree to build with for a page index."""
    share = planner.cache_shares(a.mem_budget_in_GB, a.num_PQ_chunks, a.points)[1]
    print(0 if share < 0 else planner.recommended_degree(a.dim, a.bytes, a.num_PQ_chunks, share, a.min_degree_per_node))
    return int(share < 0)


@command("plan_pages", ("dim", int, ...), ("bytes", int, 4), ("points", int, ...), ("min_degree_per_node", int, ...), ("num_PQ_chunks", int, ...), ("mem_budget_in_GB", float, ...))
def _plan(_, a):
    """Shares, page degree and nodes a page of a budget."""
    routed, cached = planner.cache_shares(a.mem_budget_in_GB, a.num_PQ_chunks, a.points)
    degree, nodes = (0, 0) if cached < 0 else planner.page_layout(a.dim, a.bytes, a.num_PQ_chunks, cached, a.min_degree_per_node)
    print(json.dumps({"routed": routed, "cached": cached, "page_degree": degree, "per_page": nodes}))
    return int(cached < 0)


@command("hash_buckets", *SOURCE, ("bits", int, hashing.PLANES), ("seed", int, 1), ("target", int, 0))
def _hash(spark, a):
    """Hash buckets and their planes, down-sampled to a target number of ids."""
    points = _read(spark, a.data_path, a.data_type)
    planes = hashing.random_planes(points.select(F.size("vec")).first()[0], a.bits, a.seed)
    table = hashing.buckets(hashing.hashes(points, planes))
    _stored(hashing.sampled_buckets(table, a.target) if a.target else table, f"{a.out}/buckets")
    _stored(hashing.planes_frame(spark, planes).coalesce(1), f"{a.out}/planes")


# ---- quantisation, partitions ----


@command("train_codes", *SOURCE, ("num_PQ_chunks", int, ...), ("rotated", int, 0), ("centres", int, quantization.CENTRES))
def _train(spark, a):
    """A codebook and the codes of all vectors."""
    points = _read(spark, a.data_path, a.data_type)
    book = quantization.fit(points, a.num_PQ_chunks, a.centres, bool(a.rotated))
    _stored(quantization.codebook_frame(spark, book).coalesce(1), f"{a.out}/book")
    _stored(quantization.encode(points, book), f"{a.out}/codes")


@command("reorder_codes", ("codes", str, ...), ("mapping", str, ...), ("out", str, ...))
def _reorder(spark, a):
    """Codes under the new ids of a map (old, new)."""
    _stored(quantization.reordered(spark.read.parquet(a.codes), spark.read.parquet(a.mapping)), a.out)


@command("partition", *SOURCE, ("most_points", int, ...), ("overlap", int, 2))
def _partition(spark, a):
    """Shards of at most so many points, each point in several."""
    _stored(clusters.partition_under(_read(spark, a.data_path, a.data_type), a.most_points, a.overlap)[1], a.out)


@command("partition_by_memory", *SOURCE, ("ram_GB", float, ...), ("R", int, 64), ("overlap", int, 2))
def _partition_memory(spark, a):
    """Shards whose graphs are built in so much memory."""
    points = _read(spark, a.data_path, a.data_type)
    one = planner.build_memory_gb(1_000_000, points.select(F.size("vec")).first()[0], files.TYPES[a.data_type].itemsize, 2 * a.R // 3) / 1_000_000
    _stored(clusters.partition_under(points, max(1, int(a.ram_GB / one)), a.overlap)[1], a.out)


@command("merge_shards", ("data_type", str, "float"), ("data_path", str, ...), ("owner", str, ...), ("out", str, ...), ("R", int, 64), ("L", int, 100), ("alpha", float, 1.2))
def _merge(spark, a):
    """One graph of shards (id, shard) that overlap."""
    _stored(graphs.build_merged(_read(spark, a.data_path, a.data_type).join(spark.read.parquet(a.owner), "id"), a.R, a.L, a.alpha), a.out)


@command("analyse", ("data_type", str, "float"), ("data_path", str, ...))
def _analyse(spark, a):
    """Percentiles of the norms."""
    print({r["percent"]: round(r["norm"], 6) for r in clusters.norm_percentiles(_read(spark, a.data_path, a.data_type)).orderBy("percent").collect()})


# ---- data ----


@command("random_vectors", ("n", int, ...), ("dim", int, ...), ("norm", float, 1.0), ("data_type", str, "float"), ("out", str, ...))
def _vectors(spark, a):
    """Random vectors of a norm."""
    files.write(generators.vectors(spark, a.n, a.dim, a.norm, a.data_type), a.out, "bin", a.data_type)


@command("random_slice", *SOURCE, ("share", float, ...), ("seed", int, 0))
def _slice(spark, a):
    """A reproducible share of the vectors; their ids beside them."""
    some = generators.bernoulli(_read(spark, a.data_path, a.data_type), a.share, a.seed)
    files.write(some, f"{a.out}/vectors", "bin", a.data_type)
    _stored(some.select("id").orderBy("id"), f"{a.out}/ids")


@command("random_labels", ("n", int, ...), ("labels", int, ...), ("kind", str, "zipf"), ("out", str, ...))
def _labels(spark, a):
    """Labels of n points, one line each: zipf, random or one."""
    made = {"zipf": generators.zipf_labels, "random": generators.random_labels, "one": generators.one_label}[a.kind](spark, a.n, a.labels)
    made.orderBy("id").select(F.concat_ws(",", "labels").alias("value")).write.mode("overwrite").text(a.out)


@command("label_statistics", ("label_file", str, ...), ("dense", int, 10))
def _label_statistics(spark, a):
    """Points, labels, percentiles of label sizes and the largest labels."""
    points = labels.parse(files.numbered_lines(spark, a.label_file))
    print(labels.statistics(points, a.dense).first().asDict())
    for r in labels.size_report(points).orderBy("kind", "place").collect():
        print(r["kind"], r["place"], r["value"], r["label"] or "")


@command("convert", ("data_type", str, "float"), ("out_type", str, ""), ("source", str, ...), ("source_format", str, ...), ("out", str, ...), ("out_format", str, ...), ("bias", float, 0.0), ("scale", float, 0.0))
def _convert(spark, a):
    """Between bin, vecs and tsv, and between types: floats are cast to bytes, or scaled to int8 and back where a scale is given."""
    points = files.read_tsv(spark, a.source).select("id", "vec") if a.source_format == "tsv" else files.read(spark, a.source, a.source_format, a.data_type)
    kind = a.out_type or a.data_type
    if a.scale:
        points = points.withColumn("vec", v.to_int8(F.col("vec"), a.bias, a.scale) if kind == "int8" else v.from_int8(F.col("vec"), a.bias, a.scale))
    elif kind == "uint8" and a.data_type == "float":
        points = points.withColumn("vec", v.to_uint8(F.col("vec")))
    if a.out_format == "tsv":
        files.write_tsv(points, a.out)
    else:
        files.write(points, a.out, a.out_format, kind)


if __name__ == "__main__":
    raise SystemExit(main())

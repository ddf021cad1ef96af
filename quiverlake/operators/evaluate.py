"""Reports of searches: exact percentiles, recall at several depths, shard recall simulation, beam width tuning."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import persisted
from . import knn


def percentiles(table: DataFrame, value: str, key: str, wanted: list[int]) -> DataFrame:
    """(percent, value): the value at index floor(p * n / 100) in order of (value, key); ranks come from range partitions and their offsets."""
    ordered = persisted(table.select(F.col(value).alias("value"), F.col(key).alias("key")).repartitionByRange("value", "key").withColumn("part", F.spark_partition_id()))
    offset, n = {}, 0
    for part, size in sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect()):
        offset[part], n = n, n + size
    if not n:
        return table.sparkSession.createDataFrame([], "percent int, value double")
    starts = F.create_map(*[F.lit(x) for pair in offset.items() for x in pair])
    rank = F.row_number().over(Window.partitionBy("part").orderBy("value", "key")) - 1 + starts[F.col("part")]
    index = {p: min(n - 1, p * n // 100) for p in wanted}
    places = F.array(*[F.struct(F.lit(p).alias("percent"), F.lit(i).alias("at")) for p, i in index.items()])
    return ordered.withColumn("rank", rank).select("value", "rank", F.explode(places).alias("p")).where("rank = p.at").select("p.percent", "value")


def report(truth: DataFrame, result: DataFrame, depths: tuple[int, ...] = (10, 5, 2, 1)) -> DataFrame:
    """(k, recall) at each depth, of (qid, rank, id, dist) tables."""
    out = None
    for k in depths:
        row = knn.recall(truth, result.where(F.col("rank") <= k), k).select(F.lit(k).alias("k"), "recall")
        out = row if out is None else out.unionByName(row)
    return out


def simulated_recall(spark, shards: int, k: int, shard_recall: float, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """One row: recall of a merged result if every shard finds each of its true neighbours with ``shard_recall``."""
    h = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    hits = spark.range(draws * k).select((F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(shards))).alias("shard"), (h < shard_recall).cast("int").alias("hit"))
    return hits.groupBy("shard").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")).agg((F.sum("hits") / F.sum("n")).alias("recall"))


def search_report(run: Callable[[], DataFrame], queries: int, truth: DataFrame | None = None, depths: tuple[int, ...] = (10, 5, 2, 1), clock: Callable[[], float] = time.perf_counter) -> dict[str, float]:
    """Runs a page search once and reports it: seconds, queries a second, and by query the mean and the 99.9th percentile of pages read, mean
    hops, and recall at several depths where ``truth`` is given. ``run`` gives a read log (qid, found, hops, pages)."""
    from . import pages

    began = clock()
    log = persisted(run())
    took = clock() - began
    each = log.groupBy("qid").agg(F.sum(F.size("pages")).alias("reads"), F.sum("hops").alias("hops"))
    row = each.agg(F.avg("reads").alias("reads"), F.percentile("reads", F.lit(0.999)).alias("most"), F.avg("hops").alias("hops")).first()
    out = {"seconds": took, "qps": queries / took if took else 0.0, "mean_latency": took / max(queries, 1), "mean_ios": row["reads"] or 0.0, "p999_ios": row["most"] or 0.0, "mean_hops": row["hops"] or 0.0}
    if truth is not None:
        found = pages.results(log, max(depths))
        out |= {f"recall_{r['k']}": r["recall"] for r in report(truth, found, depths).collect()}
    return out


def tuned_beam(run: Callable[[int], DataFrame], start: int = 2, most: int = 64, clock: Callable[[], float] = time.perf_counter) -> int:
    """The beam width (grown by a tenth, one at least) up to which a sample runs faster each time."""
    best, width, last = start, start, None
    while width <= most:
        began = clock()
        run(width).write.format("noop").mode("overwrite").save()
        took = clock() - began
        if last is not None and took >= last:
            return best
        best, last, width = width, took, max(width + 1, int(width * 1.1))
    return best

"""Means, medoids, nearest centres, Lloyd steps, k-means, partitions under a size limit. Points are (id, vec), centres (centre, vec)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import persisted
from . import knn

#: Lloyd repetitions, the relative change that stops, the training sample's bound.
LLOYD_ROUNDS = 12
LEAST_CHANGE = 1e-5
TRAINING_BOUND = 256_000


def mean(points: DataFrame) -> DataFrame:
    """(dim, mean): partial sums by task, then one row a dimension."""
    return points.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mean_vector(points: DataFrame) -> list[float]:
    return [r["mean"] for r in mean(points).orderBy("dim").collect()]


def medoid(points: DataFrame) -> DataFrame:
    """One row (id, dist): the point nearest the mean, the smallest id on ties."""
    from ..functions import vectors

    centre = F.lit(mean_vector(points))
    dist = vectors.l2(F.col("vec"), centre)
    return points.agg(F.min(F.struct(dist.alias("dist"), F.col("id"))).alias("m")).select("m.id", "m.dist")


def norm_percentiles(points: DataFrame, steps: int = 20) -> DataFrame:
    """(percent, norm): exact order statistics at index floor(p * n), the largest at 100. A range sort ranks in parallel, without one task for all."""
    from ..functions import vectors

    norms = points.select("id", vectors.norm(F.col("vec")).alias("norm"))
    n = norms.count()
    wanted = sorted({min(n - 1, i * n // steps) for i in range(steps + 1)}) if n else []
    if not n:
        return points.sparkSession.createDataFrame([], "percent int, norm double")
    ordered = norms.repartitionByRange("norm", "id").withColumn("part", F.spark_partition_id())
    ordered = persisted(ordered)
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())
    offset, total = {}, 0
    for part, size in sizes:
        offset[part], total = total, total + size
    starts = F.create_map(*[F.lit(x) for pair in offset.items() for x in pair])
    rank = F.row_number().over(Window.partitionBy("part").orderBy("norm", "id")) - 1 + starts[F.col("part")]
    picked = {r["rank"]: r["norm"] for r in ordered.withColumn("rank", rank).where(F.col("rank").isin(wanted)).select("rank", "norm").collect()}
    rows = [(100 * i // steps, float(picked[min(n - 1, i * n // steps)])) for i in range(steps + 1)]
    return points.sparkSession.createDataFrame(rows, "percent int, norm double")


def nearest(points: DataFrame, centres: DataFrame, k: int = 1) -> DataFrame:
    """(id, rank, centre, dist): the k nearest centres of each point; the centres are the stated set, in blocks. No shuffle for one block."""
    spark = points.sparkSession
    blocks = list(knn.query_blocks(centres.select(F.col("centre").alias("id"), "vec"), "id", "vec"))
    outs = []
    for ids, c in blocks:
        sent = spark.sparkContext.broadcast((np.array(ids), c))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, c = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, knn.ROWS_AT_ONCE):
                    part = batch.slice(at, knn.ROWS_AT_ONCE)
                    own = part.column("id").to_numpy()
                    row, centre, dist = knn.top_k(ids, c, knn.matrix(part.column("vec")), k, "l2")
                    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(rank, pa.int32()), pa.array(centre, pa.int64()), pa.array(dist)], ["id", "rank", "centre", "dist"])

        outs.append(points.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, rank int, centre long, dist double"))
    if not outs:
        return spark.createDataFrame([], "id long, rank int, centre long, dist double")
    if len(outs) == 1:
        return outs[0]
    merged = outs[0]
    for o in outs[1:]:
        merged = merged.unionByName(o)
    w = Window.partitionBy("id").orderBy("dist", "centre")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lloyd_step(points: DataFrame, centres: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(centre, dim, mean, n): new centres; one without points becomes zero, or stays with ``keep_empty``.

    A task sends one row of sums for each centre it meets; points are not shuffled.
    """
    spark = points.sparkSession
    ids, c = _whole(centres)
    sent = spark.sparkContext.broadcast((ids, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = sent.value
        sums, n = np.zeros_like(c), np.zeros(len(ids), np.int64)
        for part in knn.parts_of(batches):
            x = knn.matrix(part.column("vec"))
            query, centre, _ = knn.top_k(ids, c, x, 1, "l2")
            at = np.searchsorted(ids, centre)
            np.add.at(sums, at, x[query])
            n += np.bincount(at, minlength=len(ids))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(list(sums[met]), pa.list_(pa.float64())), pa.array(n[met])], ["centre", "sums", "n"])

    partial = points.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, "centre long, sums array<double>, n long")
    new = partial.select("centre", "n", F.posexplode("sums").alias("dim", "x")).groupBy("centre", "dim").agg((F.sum("x") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    old = centres.select(F.col("centre").cast("long").alias("centre"), F.posexplode("vec").alias("dim", "x"))
    rest = F.col("x").cast("double") if keep_empty else F.lit(0.0)
    return old.join(F.broadcast(new), ["centre", "dim"], "left").select("centre", "dim", F.coalesce("mean", rest).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def _whole(centres: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a stated set of centres, in order of their ids."""
    parts = list(knn.query_blocks(centres.select(F.col("centre").alias("id"), "vec"), "id", "vec"))
    return np.array([i for ids, _ in parts for i in ids], np.int64), np.vstack([c for _, c in parts]) if parts else np.zeros((0, 0))


def kmeans_whole(points: DataFrame, centres: DataFrame, rounds: int = LLOYD_ROUNDS) -> DataFrame:
    """(centre, vec) after Lloyd's rounds over all points, from the given centres; stops when the residual changes by under LEAST_CHANGE."""
    last = None
    for _ in range(rounds):
        step = lloyd_step(points, centres, True).groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("vec"))
        centres = centres.sparkSession.createDataFrame(step.collect(), "centre long, vec array<double>")
        now = residual(points, centres).first()[0] or 0.0
        if now < 1e-12 or (last is not None and abs(last - now) / now < LEAST_CHANGE):
            break
        last = now
    return centres


def residual(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One row (residual): the sum of squared distances to the nearest centre."""
    return nearest(points, centres).agg(F.sum("dist").alias("residual"))


def cluster_sizes(points: DataFrame, centres: DataFrame, k: int = 1) -> DataFrame:
    """(centre, n): how many points have the centre among their k nearest."""
    return nearest(points, centres, k).groupBy("centre").agg(F.count(F.lit(1)).alias("n"))


def sample_matrix(points: DataFrame, bound: int = TRAINING_BOUND, seed: int = 1) -> np.ndarray:
    """A bounded training sample on the driver, in the order of a seeded hash of (id, vec). Rows beyond a hash that some twice ``bound`` rows
    lie below are left out first, so no task sorts or sends the whole bound."""
    own = points.where("vec is not null")
    hashed = own.select("vec", F.xxhash64(F.lit(seed), *([F.col("id")] if "id" in points.columns else []), "vec").alias("h"))
    n = own.count()
    if n > 4 * bound:
        hashed = hashed.where(F.col("h") <= -(1 << 63) + int(2 * (bound + 100) / n * (1 << 64)))
    return knn.matrix(hashed.orderBy("h").limit(bound).select("vec").toArrow().column("vec"))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one vector, some rows at a time."""
    out = np.empty(len(x))
    for at in range(0, len(x), knn.ROWS_AT_ONCE):
        part = x[at : at + knn.ROWS_AT_ONCE] - c
        out[at : at + knn.ROWS_AT_ONCE] = np.square(part, out=part).sum(axis=1)
    return out


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeding: each next centre is drawn with the squared distance to the nearest chosen one as weight."""
    chosen = [int(rng.integers(len(x)))]
    d = _squares(x, x[chosen[0]])
    while len(chosen) < min(k, len(x)):
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(int(rng.choice(len(x), p=p)))
        d = np.minimum(d, _squares(x, x[chosen[-1]]))
    c = x[chosen]
    return np.vstack([c, np.zeros((k - len(c), x.shape[1]))]) if len(c) < k else c


def kmeans(x: np.ndarray, k: int, rounds: int = LLOYD_ROUNDS, seed: int = 1, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(centres, owner of each row, residual) by Lloyd's rounds; stops when the residual changes by less than LEAST_CHANGE. Rows meet the
    centres some at a time, so that no matrix of all distances is held."""
    c = seeds(x, k, np.random.default_rng(seed)) if start is None else start.copy()
    last = np.inf
    owner, nearest_ = np.zeros(len(x), int), np.zeros(len(x))
    for _ in range(rounds):
        for at in range(0, len(x), knn.ROWS_AT_ONCE):
            some = slice(at, at + knn.ROWS_AT_ONCE)
            d = knn.approximate("l2", x[some], c)
            owner[some] = d.argmin(axis=1)
            nearest_[some] = np.maximum(d.min(axis=1), 0)
        total = float(nearest_.sum())
        n = np.bincount(owner, minlength=k)
        sums = np.stack([np.bincount(owner, column, k) for column in np.ascontiguousarray(x.T)], axis=1) if x.shape[1] else np.zeros_like(c)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if total < 1e-12 or (np.isfinite(last) and abs(last - total) / max(total, 1e-300) < LEAST_CHANGE):
            last = total
            break
        last = total
    return c, owner, last


def centres_frame(spark, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "centre long, vec array<double>")


def partition(points: DataFrame, parts: int, overlap: int = 2, seed: int = 1) -> DataFrame:
    """(id, shard): each point in the shards of its ``overlap`` nearest centres, trained on a bounded sample."""
    c, _, _ = kmeans(sample_matrix(points, seed=seed), parts, seed=seed)
    return nearest(points, centres_frame(points.sparkSession, c), min(overlap, parts)).select("id", F.col("centre").alias("shard"))


def partition_under(points: DataFrame, most_points: int, overlap: int = 2, seed: int = 1, start: int = 1) -> tuple[int, DataFrame]:
    """(parts, (id, shard)): from ``start`` parts on, more until the largest shard, as counted, has at most ``most_points`` points.

    The sample tells where to begin counting; each count of the real rows that is above the bound adds parts. Shards that stay too large
    however many parts there are, as copies of one vector do, are dealt out by a hash of the id.
    """
    x = sample_matrix(points, seed=seed)
    n = points.count()
    parts = max(start, -(-n * min(overlap, 2) // max(most_points, 1))) if n > most_points else 1
    spark = points.sparkSession
    for _ in range(6):
        c, _, _ = kmeans(x, parts, seed=seed)
        owner = persisted(nearest(points, centres_frame(spark, c), min(overlap, parts)).select("id", F.col("centre").alias("shard")))
        sizes = owner.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        if largest <= most_points or parts >= max(len(x), 1):
            break
        parts = min(max(parts + 2, int(parts * 1.5)), max(len(x), 1))
    if largest <= most_points:
        return parts, owner
    pieces = F.ceil(F.col("n") / F.lit(most_points))
    dealt = owner.join(F.broadcast(sizes), "shard").select("id", F.xxhash64("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), pieces)).alias("shard"))
    return dealt.select("shard").distinct().count(), dealt


def sharded_under(points: DataFrame, most_points: int, overlap: int = 1, seed: int = 1) -> DataFrame:
    """``points`` with their shard, written: shards of at most ``most_points`` points, each point in ``overlap`` of them."""
    return persisted(points.join(partition_under(points, most_points, overlap, seed)[1], "id"))

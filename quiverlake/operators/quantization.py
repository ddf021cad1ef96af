"""Product quantisation: training, encoding, asymmetric distances, decoding, rotation. Codebooks are (chunk, code, centre)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import chunk_offsets
from . import clusters, knn

CENTRES = 256
ROTATION_ROUNDS = 20
#: Queries of a block, whose tables a task holds (32 MB at 16 chunks of 256 codes), and of one product.
TABLE_BLOCK = 1024
TABLES_AT_ONCE = 256


@dataclass
class Codebook:
    """Centres of each chunk, the subtracted mean, and a rotation (None: the identity). Its size does not depend on the data's."""

    offsets: list[int]
    centres: list[np.ndarray]
    mean: np.ndarray
    rotation: np.ndarray | None = field(default=None)

    @property
    def chunks(self) -> int:
        return len(self.centres)

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = self.prepared(x)
        out = np.empty((len(x), self.chunks), np.int16)
        for m, c in enumerate(self.centres):
            part = x[:, self.offsets[m] : self.offsets[m + 1]]
            out[:, m] = ((part[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).argmin(axis=1) if len(part) * len(c) < 4_000_000 else knn.approximate("l2", part, c).argmin(axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Centres put together, without undoing a rotation, plus the mean."""
        return np.hstack([c[codes[:, m]] for m, c in enumerate(self.centres)]) + self.mean

    def restored(self, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for, in the space of the vectors: decoded, with a rotation undone."""
        parts = np.hstack([c[codes[:, m]] for m, c in enumerate(self.centres)])
        return (parts if self.rotation is None else parts @ self.rotation.T) + self.mean

    def tables(self, q: np.ndarray, metric: str = "l2") -> np.ndarray:
        """(queries, chunks, codes): the distance of each query's chunk to each centre."""
        q = self.prepared(q)
        out = np.full((len(q), self.chunks, max(len(c) for c in self.centres)), np.inf)
        for m, c in enumerate(self.centres):
            part = q[:, self.offsets[m] : self.offsets[m + 1]]
            out[:, m, : len(c)] = -(part @ c.T) if metric == "ip" else ((part[:, None, :] - c[None]) ** 2).sum(axis=2)
        return out

    def scores(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(rows, queries): sums of table entries."""
        out = np.zeros((len(codes), len(tables)))
        for m in range(self.chunks):
            out += tables[:, m, :].T[codes[:, m]]
        return out


def train(x: np.ndarray, chunks: int, centres: int = CENTRES, centred: bool = True, rounds: int = clusters.LLOYD_ROUNDS, seed: int = 1) -> Codebook:
    """k-means in each chunk of a bounded training matrix."""
    mean = x.mean(axis=0) if centred and len(x) else np.zeros(x.shape[1])
    offsets = chunk_offsets(x.shape[1], chunks)
    z = x - mean
    parts = [clusters.kmeans(z[:, a:b], centres, rounds, seed + m)[0] for m, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False))]
    return Codebook(offsets, parts, mean)


def train_rotated(x: np.ndarray, chunks: int, centres: int = CENTRES, rounds: int = ROTATION_ROUNDS, seed: int = 1) -> Codebook:
    """Alternates quantisation of the rotated data (warm starts) and the best rotation for it (from a singular value decomposition)."""
    offsets = chunk_offsets(x.shape[1], chunks)
    rotation = np.eye(x.shape[1])
    parts: list[np.ndarray | None] = [None] * chunks
    for r in range(rounds):
        z = x @ rotation
        quantized = np.empty_like(z)
        for m, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
            c, _, _ = clusters.kmeans(z[:, a:b], centres, 8 if r else clusters.LLOYD_ROUNDS, seed + m, parts[m])
            parts[m] = c
            quantized[:, a:b] = c[knn.approximate("l2", z[:, a:b], c).argmin(axis=1)]
        u, _, vt = np.linalg.svd(x.T @ quantized)
        rotation = u @ vt
    return Codebook(offsets, parts, np.zeros(x.shape[1]), rotation)


def fit(points: DataFrame, chunks: int, centres: int = CENTRES, rotated: bool = False, metric: str = "l2", seed: int = 1) -> Codebook:
    """Trains on a bounded sample; centred for L2 only."""
    x = clusters.sample_matrix(points, seed=seed)
    return train_rotated(x, chunks, centres, seed=seed) if rotated else train(x, chunks, centres, metric != "ip", seed=seed)


def encode(points: DataFrame, book: Codebook) -> DataFrame:
    """(id, codes array<short>) of (id, vec), in the scan's own tasks."""
    sent = points.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, knn.ROWS_AT_ONCE):
                part = batch.slice(at, knn.ROWS_AT_ONCE)
                codes = sent.value.encode(knn.matrix(part.column("vec")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel(), pa.int16()), codes.shape[1]).cast(pa.list_(pa.int16()))], ["id", "codes"])

    return points.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, codes array<short>")


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    """(id, vec) of (id, codes)."""
    sent = codes.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = sent.value.decode(knn.matrix(batch.column("codes")).astype(int))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "vec"])

    return codes.select("id", "codes").mapInArrow(run, "id long, vec array<double>")


def prepared(points: DataFrame, book: Codebook) -> DataFrame:
    """(id, vec): vectors as a codebook sees them, less its mean and rotated."""
    sent = points.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in knn.parts_of(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(sent.value.prepared(knn.matrix(part.column("vec")))), pa.list_(pa.float64()))], ["id", "vec"])

    return points.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, vec array<double>")


def restored(points: DataFrame, book: Codebook) -> DataFrame:
    """(id, vec): what the codes of the vectors stand for."""
    sent = points.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in knn.parts_of(batches):
            x = sent.value.restored(sent.value.encode(knn.matrix(part.column("vec"))))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "vec"])

    return points.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, vec array<double>")


def error(points: DataFrame, book: Codebook) -> float:
    """The mean squared distance of all vectors to what their codes stand for."""
    sent = points.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for part in knn.parts_of(batches):
            x = knn.matrix(part.column("vec"))
            total, n = total + float(((x - sent.value.restored(sent.value.encode(x))) ** 2).sum()), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64())], ["total", "n"])

    row = points.select("vec").where("vec is not null").mapInArrow(run, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
    return (row[0] or 0.0) / max(row[1] or 0, 1)


def knn_pq(codes: DataFrame, queries: DataFrame, book: Codebook, k: int, metric: str = "l2") -> DataFrame:
    """(qid, rank, id, dist): the best k by asymmetric distances. The codebook and a block's queries are sent; a task makes the tables of
    some queries at a time and keeps its best k of each."""

    def block(parts: tuple) -> DataFrame:
        sent = codes.sparkSession.sparkContext.broadcast((np.array(parts[0]), parts[1], book))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, book = sent.value
            best = knn.Best(len(q), k)
            tables = [book.tables(q[at : at + TABLES_AT_ONCE], metric) for at in range(0, len(q), TABLES_AT_ONCE)]
            for part in knn.parts_of(batches):
                ids, own = part.column("id").to_numpy(), knn.matrix(part.column("codes")).astype(int)
                for at, some in enumerate(tables):
                    score = book.scores(some, own)
                    keep = min(k, len(ids))
                    limit = np.partition(score, keep - 1, axis=0)[keep - 1]
                    row, query = np.nonzero(score <= limit)
                    best.add(query + at * TABLES_AT_ONCE, ids[row], score[row, query])
            yield best.batch(qids)

        return codes.select("id", "codes").mapInArrow(run, knn.FOUND)

    return knn.ranked(knn.over_blocks(queries, [], block, TABLE_BLOCK), k)


def knn_reranked(points: DataFrame, codes: DataFrame, queries: DataFrame, book: Codebook, k: int, candidates: int) -> DataFrame:
    """The best ``candidates`` by codes, scored again with their vectors; (qid, rank, id, dist). Joins move candidates, not the base."""
    from ..functions import vectors

    some = knn_pq(codes, queries, book, candidates).select("qid", "id")
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    scored = some.join(points.select("id", "vec"), "id").join(q, "qid").select("qid", "id", vectors.l2(F.col("vec"), F.col("q")).alias("dist"))
    return knn.ranked(scored, k)


def codebook_frame(spark, book: Codebook) -> DataFrame:
    """The codebook as a table (chunk, code, centre, offset, mean, rotation): a row for each centre, and one of chunk -1 with what all share."""
    rows = [(m, i, [float(v) for v in row], book.offsets[m], None, None) for m, c in enumerate(book.centres) for i, row in enumerate(c)]
    rotation = None if book.rotation is None else [[float(v) for v in row] for row in book.rotation]
    rows.append((-1, 0, None, book.offsets[-1], [float(v) for v in book.mean], rotation))
    return spark.createDataFrame(rows, "chunk int, code int, centre array<double>, offset int, mean array<double>, rotation array<array<double>>")


def codebook_of(table: DataFrame) -> Codebook:
    """The codebook of a table that ``codebook_frame`` made."""
    rows = sorted(table.select("chunk", "code", "offset", "centre", "mean", "rotation").collect(), key=lambda r: (r["chunk"], r["code"]))
    shared, cells = rows[0], rows[1:]
    if not cells or shared["chunk"] != -1:
        raise ValueError("the table holds no whole codebook")
    chunks = cells[-1]["chunk"] + 1
    centres = [np.array([r["centre"] for r in cells if r["chunk"] == m]) for m in range(chunks)]
    offsets = [next(r["offset"] for r in cells if r["chunk"] == m) for m in range(chunks)] + [shared["offset"]]
    rotation = None if shared["rotation"] is None else np.array(shared["rotation"])
    return Codebook(offsets, centres, np.array(shared["mean"]), rotation)


def residuals(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, centre, vec): the vectors less their nearest centre."""
    from ..functions import vectors

    owner = clusters.nearest(points, centres).select("id", "centre")
    named = points.select("id", "vec").join(owner, "id").join(F.broadcast(centres.select("centre", F.col("vec").alias("c"))), "centre")
    return named.select("id", "centre", vectors.plus(F.col("vec"), F.col("c"), -1).alias("vec"))


def reordered(codes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, codes) under the new ids of (old, new)."""
    return codes.join(mapping.select(F.col("old").alias("id"), "new"), "id").select(F.col("new").alias("id"), "codes")


def adc_pairs(codes: DataFrame, queries: DataFrame, centres: DataFrame, width: int, metric: str = "l2") -> DataFrame:
    """(qid, id, dist) of queries (qid, id of their candidate, vec) by SQL joins with the codebook table; ``width``: dimensions a chunk.

    l2, or ip: the negative inner product with the centres.
    """
    from ..functions import vectors

    cells = queries.select("qid", "id", "vec").join(codes, "id").select("qid", "id", "vec", F.posexplode("codes").alias("chunk", "code"))
    part = F.slice("vec", F.col("chunk") * width + 1, width)
    each = vectors.inner_product(part, F.col("centre")) if metric == "ip" else vectors.l2(part, F.col("centre"))
    own = centres.where("chunk >= 0").select("chunk", "code", "centre")
    return cells.join(F.broadcast(own), ["chunk", "code"]).select("qid", "id", "chunk", each.alias("d")).groupBy("qid", "id").agg(F.sum("d").alias("dist"))

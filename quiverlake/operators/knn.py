"""Exact nearest neighbours: all metrics, filters, ranges, parts, recall.

The queries are a stated set. They are taken to the driver in blocks of at most QUERY_BLOCK and sent to the tasks that scan the base; a
task keeps its best k of each query only, and a window over these partial results ends it. A base row is read once a block; nothing grows
with the product of both sides but arithmetic, and the shuffle has tasks * queries * k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 10_000
#: Rows and queries compared at once, which bounds the distance matrix, and values of vectors whose distances are made again exactly at once.
ROWS_AT_ONCE = 2048
QUERIES_AT_ONCE = 256
VALUES_AT_ONCE = 2_000_000


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a (rows, dimensions) matrix; all rows must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def approximate(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(rows, queries) distances by matrix products, right up to rounding."""
    products = x @ q.T
    if metric == "ip":
        return -products
    if metric == "fast_l2":
        return (x * x).sum(axis=1)[:, None] - 2 * products
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - products / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((q * q).sum(axis=1))[None, :]
    return (x * x).sum(axis=1)[:, None] - 2 * products + (q * q).sum(axis=1)[None, :]


def exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of paired rows, summed left to right."""
    run = lambda a: np.cumsum(a, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))
    if metric == "ip":
        return -run(x * q)
    if metric == "fast_l2":
        return run(x * x) - 2 * run(x * q)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - run(x * q) / (np.sqrt(run(x * x)) * np.sqrt(run(q * q)))
    return run((x - q) ** 2)


class Rows:
    """Vectors as one side of a comparison: their matrix, squared norms, and in single precision the factors whose products are distances."""

    def __init__(self, x: np.ndarray, metric: str, queries: bool = False):
        self.x, self.metric, self.queries = x, metric, queries
        self.squares = (x * x).sum(axis=1)
        # without squares that overflow, or norms of zero that a cosine divides by
        self.plain = bool((self.squares < 1e30).all()) and (metric != "cosine" or bool((self.squares > 0).all()))
        self._single: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.x)

    @property
    def single(self) -> np.ndarray:
        if self._single is None:
            x, squares, one = self.x, self.squares[:, None], np.ones((len(self.x), 1))
            more = {"ip": [], "cosine": [one], "fast_l2": [one if self.queries else squares], "l2": [one, squares] if self.queries else [squares, one]}[self.metric]
            if self.metric == "cosine":
                x = x / np.sqrt(squares)
            if self.queries:
                x = x * (-1 if self.metric in ("ip", "cosine") else -2)
            self._single = np.hstack([x, *more]).astype(np.float32)
        return self._single

    def error(self, other: Rows, unit: float) -> np.ndarray:
        """How far distances by products may be from the exact ones: for each of these queries, over all rows of the other side."""
        most = other.squares[np.isfinite(other.squares)].max(initial=0.0)
        own = np.where(np.isfinite(self.squares), self.squares, 0.0)
        size = np.full(len(own), 2.0) if self.metric == "cosine" else np.sqrt(own * most) if self.metric == "ip" else 2 * np.sqrt(own * most) + own + most
        return (self.x.shape[1] + 10) * unit * size + 1e-37


def _reached(rough: np.ndarray, limit: np.ndarray, error: np.ndarray, keep: int, marks: np.ndarray, rows: bool) -> np.ndarray:
    """Flat places of a matrix of distances that are within the limits of its rows (or else columns), or among its best ``keep`` where a limit is infinite."""
    top = np.where(np.isnan(limit), np.inf, limit)
    if (unknown := np.isinf(top)).any():
        own = (rough if rows else rough.T)[unknown]
        top[unknown] = np.partition(own, min(keep, own.shape[1]) - 1, axis=1)[:, min(keep, own.shape[1]) - 1] + error[unknown]
    top = (top + error).astype(rough.dtype)
    np.less_equal(rough, top[:, None] if rows else top[None, :], out=marks)
    flat = marks.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    # most marks are not set: eight at a time are looked at first
    words = np.flatnonzero(flat.view(np.uint64))
    which, byte = np.nonzero(flat.reshape(-1, 8)[words])
    return words[which] * 8 + byte


def compared(base: Rows, queries: Rows, k: int, limit: np.ndarray | None = None, back: Best | None = None, same: tuple | None = None) -> Iterator[tuple]:
    """(whether for the query, query, row, distance) of the pairs that can be among the best ``k`` of a query, or of a row for ``back``, in pieces of bounded size.

    ``limit``: distances above which a query wants no row. Products in single precision, of bounded error, find the pairs; where they find
    many, as among copies, products in double precision do. The distances are exact. ``same``: the ids of both sides; equal ones are no pair.
    """
    if not len(base) or not len(queries):
        return
    plain = base.plain and queries.plain
    limit = np.full(len(queries), np.inf) if limit is None else limit
    units = {True: 2.0**-23, False: 2.0**-52}
    errors = {single: (queries.error(base, unit), base.error(queries, unit)) for single, unit in units.items()}
    room, marks = (np.empty((QUERIES_AT_ONCE, len(base)), kind) for kind in (np.float32, bool))
    pairs = max(1, VALUES_AT_ONCE // max(base.x.shape[1], 1))
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        some = slice(at, at + QUERIES_AT_ONCE)
        n = len(limit[some])
        equal = None if same is None else same[1][some, None] == same[0][None, :]
        for single in (True, False) if plain else (False,):
            if single:
                rough = np.matmul(queries.single[some], base.single.T, out=room[:n])
            else:
                rough = np.ascontiguousarray(np.nan_to_num(approximate(base.metric, base.x, queries.x[some]), nan=np.inf).T)
            if equal is not None:
                rough[equal] = np.inf
            hits = [(True, _reached(rough, limit[some], errors[single][0][some], k, marks[:n], True))]
            if back is not None:
                hits.append((False, _reached(rough, back.limit, errors[single][1], k, marks[:n], False)))
            if not single or sum(len(h) for _, h in hits) <= 8 * k * (n + (back is not None) * len(base)):
                break
        for forward, places in hits:
            for part in range(0, len(places), pairs):
                query, row = np.divmod(places[part : part + pairs], len(base))
                if equal is not None:
                    query, row = (c[~equal[query, row]] for c in (query, row))
                dist = exact(base.metric, base.x[row], queries.x[some][query])
                good = ~(dist > (limit[some][query] if forward else back.limit[row]))
                yield forward, query[good] + at, row[good], dist[good]


def near(base: Rows, queries: Rows, k: int, limit: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, distance) of the pairs that can be among the best ``k`` of a query, queries in order."""
    for _, *pair in compared(base, queries, k, limit):
        yield tuple(pair)


def top_k(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, distance) of the best k rows of each query; ties by id."""
    best = Best(len(q), k)
    best.scan(ids, Rows(x, metric), Rows(q, metric, True))
    return best.merged()


def query_blocks(queries: DataFrame, qid: str, vec: str, more: list[str] | None = None, size: int | None = None) -> Iterator[tuple]:
    """(ids, matrix[, values of further columns]) of the stated queries in blocks of ``size`` (QUERY_BLOCK), in order of their id."""
    size, last = size or QUERY_BLOCK, None
    while True:
        part = queries.where(F.col(vec).isNotNull()) if last is None else queries.where(F.col(vec).isNotNull() & (F.col(qid) > last))
        rows = part.orderBy(qid).select(F.col(qid).cast("long"), vec, *(more or [])).limit(size).collect()
        if not rows:
            return
        yield [r[0] for r in rows], np.array([r[1] for r in rows], np.float64), *([r[2 + i] for r in rows] for i in range(len(more or [])))
        if len(rows) < size:
            return
        last = rows[-1][0]


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist): the best k of (qid, id, dist), ties by id."""
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


class Best:
    """The best k (id, distance) of each of some queries, kept up to date by a task; ties by id. What is added waits until it is half of what is held."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.held = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple] = []
        #: The distance of a query's last place, infinite while it has free ones.
        self.limit = np.full(queries, np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        if len(query):
            self.waiting.append((query, ids, dist))
            if 2 * sum(len(w[0]) for w in self.waiting) > len(self.held[0]):
                self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance), in this order of keys: query, distance, id."""
        if self.waiting:
            query, ids, dist = (np.concatenate(c) for c in zip(self.held, *self.waiting, strict=True))
            order = np.lexsort((ids, dist, query))
            query, ids, dist = query[order], ids[order], dist[order]
            place = np.arange(len(query)) - np.searchsorted(query, np.arange(self.queries))[query]
            keep = place < self.k
            self.held, self.waiting = (query[keep], ids[keep], dist[keep]), []
            self.limit[query[place == self.k - 1]] = dist[place == self.k - 1]
        return self.held

    def scan(self, ids: np.ndarray, base: Rows, queries: Rows) -> None:
        """Adds what some base rows hold for the queries."""
        for query, row, dist in near(base, queries, self.k, self.limit.copy()):
            self.add(query, ids[row], dist)

    def meet(self, own: np.ndarray, queries: Rows, ids: np.ndarray, base: Rows, back: Best | None, same: bool) -> None:
        """As ``scan``, and adds to ``back`` what the queries, whose ids are ``own``, hold for the base rows. ``same``: some ids are on both sides."""
        for forward, query, row, dist in compared(base, queries, self.k, self.limit.copy(), back, (ids, own) if same else None):
            if forward:
                self.add(query, ids[row], dist)
            else:
                back.add(row, own[query], dist)

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        query, ids, dist = self.merged()
        return pa.RecordBatch.from_arrays([pa.array(qids[query], pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())], ["qid", "id", "dist"])


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS_AT_ONCE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


FOUND = "qid long, id long, dist double"


def over_blocks(queries: DataFrame, columns: list[str], run, size: int | None = None) -> DataFrame:
    """The union of ``run(block)`` over the blocks of the stated queries; a block is their ids, vectors and further columns."""
    out = None
    for block in query_blocks(queries, "id", "vec", columns, size):
        some = run(block)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else queries.sparkSession.createDataFrame([], FOUND)


def partial(base: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """(qid, id, dist): the best k of each query in each task."""

    def block(parts: tuple) -> DataFrame:
        sent = base.sparkSession.sparkContext.broadcast((np.array(parts[0]), parts[1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            best, asked = Best(len(q), k), Rows(q, metric, True)
            for part in parts_of(batches):
                best.scan(part.column("id").to_numpy(), Rows(matrix(part.column("vec")), metric), asked)
            yield best.batch(qids)

        return base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, FOUND)

    return over_blocks(queries, [], block)


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(qid, rank, id, dist) of the k nearest base rows of each query. Both sides: (id, vec). Null vectors match nothing."""
    if metric not in ("l2", "ip", "cosine", "fast_l2"):
        raise ValueError(f"unknown metric {metric}")
    return ranked(partial(base, queries, k, metric), k)


def knn_filtered(base: DataFrame, queries: DataFrame, k: int, keep: Column, metric: str = "l2") -> DataFrame:
    """As ``knn``, over the base rows that satisfy ``keep``: the filter reaches the scan."""
    return knn(base.where(keep), queries, k, metric)


def knn_by_label(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Each query sees the base rows that share its label: (id, vec, labels array) and (id, vec, label).

    One scan of the base for a block of queries; a task groups its rows by the labels that queries ask for. Queries without label find nothing.
    """

    def block(parts: tuple) -> DataFrame:
        sent = base.sparkSession.sparkContext.broadcast((np.array(parts[0]), parts[1], np.array([str(x) for x in parts[2]])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, wanted = sent.value
            best = Best(len(q), k)
            asked = {label: np.flatnonzero(wanted == label) for label in set(wanted.tolist())}
            for part in parts_of(batches):
                ids, x = part.column("id").to_numpy(), matrix(part.column("vec"))
                rows: dict[str, list[int]] = {}
                for i, own in enumerate(part.column("labels").to_pylist()):
                    for label in set(map(str, own or ())) & asked.keys():
                        rows.setdefault(label, []).append(i)
                for label, at in rows.items():
                    query, found, dist = top_k(ids[at], x[at], q[asked[label]], k, metric)
                    best.add(asked[label][query], found, dist)
            yield best.batch(qids)

        return base.select(F.col("id").cast("long").alias("id"), "vec", "labels").where("vec is not null").mapInArrow(run, FOUND)

    return ranked(over_blocks(queries.where("label is not null"), ["label"], block), k)


def within_range(base: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """(qid, id, dist) of all base rows with dist <= radius; a task returns the matches of its own rows."""

    def block(parts: tuple) -> DataFrame:
        sent = base.sparkSession.sparkContext.broadcast((np.array(parts[0]), parts[1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            asked = Rows(q, metric, True)
            for part in parts_of(batches):
                ids, x = part.column("id").to_numpy(), Rows(matrix(part.column("vec")), metric)
                for query, row, dist in near(x, asked, 1, np.full(len(q), radius)):
                    hit = dist <= radius
                    yield pa.RecordBatch.from_arrays([pa.array(qids[query[hit]], pa.int64()), pa.array(ids[row[hit]], pa.int64()), pa.array(dist[hit])], ["qid", "id", "dist"])

        return base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, FOUND)

    return over_blocks(queries, [], block)


def recall(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """One row: recall in percent of result (qid, id) against truth (qid, rank, id, dist). Truth ties with rank k count; duplicates once."""
    at_k = truth.where(F.col("rank") == k).select("qid", F.col("dist").alias("limit"))
    extended = truth.join(at_k, "qid", "left").where((F.col("rank") <= k) | (F.col("dist") == F.col("limit"))).select("qid", "id").distinct()
    queries = truth.select("qid").distinct().count()
    hits = result.select("qid", "id").distinct().join(extended, ["qid", "id"]).groupBy("qid").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("hits"))
    return hits.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).select((100.0 * F.col("hits") / F.lit(queries * k)).alias("recall"))

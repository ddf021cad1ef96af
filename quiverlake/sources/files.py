"""Binary and text formats of vectors, ids, truth, graphs and labels, read in parallel and written part by part.

``bin``: int32 rows, int32 dimensions, then rows of float32, int8 or uint8. ``fvecs``, ``bvecs`` and ``ivecs``: int32 dimensions before each row.
Paths are Spark's; readers get the bytes from Spark's file scan, so any file system Spark reads will do. A large ``bin`` file is read in
row ranges by the data source ``quiver_bin`` where the path is one that executors open themselves.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import persisted

#: Rows of a piece that is written or read at once.
PIECE = 4096
TYPES = {"float": np.dtype("<f4"), "int8": np.dtype("i1"), "uint8": np.dtype("u1"), "uint32": np.dtype("<u4"), "int32": np.dtype("<i4")}
SQL_TYPES = {"float": "float", "int8": "tinyint", "uint8": "smallint", "uint32": "bigint", "int32": "int"}


def parse_bin(body: bytes, kind: str, offset: int = 0) -> np.ndarray:
    """The matrix of a ``bin`` block; raises where the body is shorter than its header says."""
    rows, dims = struct.unpack_from("<ii", body, offset)
    kind_ = TYPES[kind]
    if len(body) - offset - 8 < rows * dims * kind_.itemsize:
        raise ValueError(f"{rows} x {dims} {kind} need more than the {len(body) - offset - 8} bytes there are")
    return np.frombuffer(body, kind_, rows * dims, offset + 8).reshape(rows, dims)


def format_bin(x: np.ndarray, kind: str) -> bytes:
    return struct.pack("<ii", *x.shape) + np.ascontiguousarray(x, TYPES[kind]).tobytes()


def parse_vecs(body: bytes, kind: str) -> np.ndarray:
    """Rows that each begin with their number of dimensions; all must agree."""
    if not body:
        return np.zeros((0, 0), TYPES[kind])
    dims = struct.unpack_from("<i", body)[0]
    width = 4 + dims * TYPES[kind].itemsize
    if len(body) % width:
        raise ValueError("the file is no whole number of rows")
    rows = np.frombuffer(body, np.uint8).reshape(-1, width)
    if (rows[:, :4].copy().view("<i4") != dims).any():
        raise ValueError("rows of different dimensions")
    return rows[:, 4:].copy().view(TYPES[kind]).reshape(len(rows), dims)


def format_vecs(x: np.ndarray, kind: str) -> bytes:
    head = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
    return np.hstack([head, np.ascontiguousarray(x, TYPES[kind]).view(np.uint8).reshape(len(x), -1)]).tobytes() if len(x) else b""


def heads(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, int]]:
    """The first two little-endian integers of each file, read by the driver: 8 bytes a file."""
    out = {}
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        out[path] = struct.unpack("<ii", struct.pack(">ii", stream.readInt(), stream.readInt()))
        stream.close()
    return out


def read(spark: SparkSession, path: str, layout: str = "bin", kind: str = "float") -> DataFrame:
    """(id, vec) of a file or folder of files, ids counted through in order of file names; a file is one task."""
    parse = parse_bin if layout == "bin" else parse_vecs
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("path", "length").orderBy("path").collect()
    head = heads(spark, [r["path"] for r in sizes if r["length"] >= 8])
    if layout == "bin":
        rows = {p: n for p, (n, _) in head.items()}
    else:
        rows = {r["path"]: r["length"] // (4 + TYPES[kind].itemsize * head[r["path"]][0]) for r in sizes if r["length"] >= 8}
    first, at = {}, 0
    for r in sizes:
        first[r["path"]], at = at, at + rows.get(r["path"], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                x = parse(body, kind)
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096]
                    vec = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel().astype({"uint8": "i2", "uint32": "i8"}.get(kind, part.dtype))), part.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part)) + first[name]), vec.cast(pa.list_(vec.type.value_type))], ["id", "vec"])

    return files.select("path", "content").mapInArrow(run, f"id long, vec array<{SQL_TYPES[kind]}>")


class BinSource(DataSource):
    """``spark.read.format("quiver_bin").option("path", ..).option("kind", "float").load()``: one input partition a row range."""

    @classmethod
    def name(cls) -> str:
        return "quiver_bin"

    def schema(self) -> str:
        return f"id long, vec array<{SQL_TYPES[self.options.get('kind', 'float')]}>"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return BinReader(self.options)


class RowRange(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__(None)
        self.start, self.stop = start, stop


class BinReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "float")
        self.step = int(options.get("rowsPerPartition", "1000000"))
        with open(self.path, "rb") as f:
            self.rows, self.dims = struct.unpack("<ii", f.read(8))

    def partitions(self) -> list[RowRange]:
        return [RowRange(a, min(a + self.step, self.rows)) for a in range(0, self.rows, self.step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        width = self.dims * TYPES[self.kind].itemsize
        with open(self.path, "rb") as f:
            f.seek(8 + partition.start * width)
            x = np.frombuffer(f.read((partition.stop - partition.start) * width), TYPES[self.kind]).reshape(-1, self.dims)
        for i, row in enumerate(x.tolist()):
            yield partition.start + i, row


def create(spark: SparkSession, path: str):
    """An output stream of the path's own file system; an older file is replaced."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)


def content(spark: SparkSession, path: str) -> bytes:
    """The bytes of one file, such as a truth file of a stated query set."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_blocks(spark: SparkSession, path: str, blocks: list[tuple[np.ndarray, str]]) -> list[int]:
    """Writes (matrix, kind) blocks one behind the other into one file, as codebooks are; returns their offsets, by which ``parse_bin`` reads them."""
    offsets, at, out = [], 0, create(spark, path)
    for x, kind in blocks:
        body = format_bin(x, kind)
        out.write(bytearray(body))
        offsets.append(at)
        at += len(body)
    out.close()
    return offsets


def write(points: DataFrame, path: str, layout: str = "bin", kind: str = "float", parts: int = 1) -> None:
    """Writes (id, vec) as files ``part-<n>``, in order of id over all files, through the file system of the path.

    Executors format the rows. Binary files have no sink in Spark, so their bytes pass the driver, PIECE rows at a time: its memory does not
    grow with the data.
    """
    spark = points.sparkSession
    ordered = points.select("id", "vec").repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    ordered = persisted(ordered)
    sizes = {r["part"]: (r["n"], r["dims"]) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECE):
                some = batch.slice(lo, PIECE)
                flat = some.column("vec").flatten().to_numpy(zero_copy_only=False)
                x = flat.reshape(some.num_rows, -1).astype(TYPES[kind])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() if layout == "bin" else format_vecs(x, kind)], pa.binary())], ["body"])

    for part in range(max(sizes, default=-1) + 1):
        out = create(spark, f"{path}/part-{part:05d}")
        n, dims = sizes.get(part, (0, 0))
        if layout == "bin":
            out.write(bytearray(struct.pack("<ii", n, dims)))
        if n:
            one = ordered.where(F.col("part") == part).select("id", "vec").repartitionByRange(1, "id").sortWithinPartitions("id")
            for r in one.mapInArrow(run, "body binary").toLocalIterator():
                out.write(bytearray(r["body"]))
        out.close()


def numbered_lines(spark: SparkSession, path: str, column: str = "line", blanks: bool = True) -> DataFrame:
    """(id, line) of a text file or a folder of them, numbered in order of file names and lines; ``blanks``: blank lines count."""
    paths = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]
    lines = spark.sparkContext.union([spark.sparkContext.textFile(p) for p in paths])
    if not blanks:
        lines = lines.filter(lambda x: bool(x.strip()))
    return lines.zipWithIndex().toDF(f"{column} string, id long").select("id", column)


def read_tsv(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """(id, line, vec) of text lines, numbered in order of files and lines; blank lines are left out."""
    return numbered_lines(spark, path, blanks=False).select("id", "line", F.transform(F.split(F.trim("line"), sep), lambda x: x.cast("float")).alias("vec"))


def write_tsv(points: DataFrame, path: str) -> None:
    points.orderBy("id").select(F.array_join(F.transform("vec", lambda x: x.cast("string")), "\t").alias("value")).write.mode("overwrite").text(path)


def parse_truth(body: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(ids, distances or None) of a truth file: the file's size tells whether distances follow."""
    n, k = struct.unpack_from("<ii", body)
    ids = np.frombuffer(body, "<u4", n * k, 8).reshape(n, k)
    if len(body) == 8 + 8 * n * k:
        return ids, np.frombuffer(body, "<f4", n * k, 8 + 4 * n * k).reshape(n, k)
    if len(body) == 8 + 4 * n * k:
        return ids, None
    raise ValueError("the size fits neither ids alone nor ids and distances")


def format_truth(ids: np.ndarray, dist: np.ndarray | None = None) -> bytes:
    return struct.pack("<ii", *ids.shape) + ids.astype("<u4").tobytes() + (b"" if dist is None else dist.astype("<f4").tobytes())


def truth_frame(spark: SparkSession, body: bytes) -> DataFrame:
    """(qid, rank, id, dist) of a truth file; its size is queries * k."""
    ids, dist = parse_truth(body)
    rows = [(q, r + 1, int(i), None if dist is None else float(dist[q, r])) for q, row in enumerate(ids) for r, i in enumerate(row)]
    return spark.createDataFrame(rows, "qid long, rank int, id long, dist double")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_frame(spark, content(spark, path))


def write_truth(found: DataFrame, path: str) -> None:
    """(qid, rank, id, dist) as a truth file, queries in order of their ids; all must have the same number of results."""
    rows = sorted(tuple(r) for r in found.select("qid", "rank", "id", "dist").collect())
    queries = len({r[0] for r in rows})
    if queries and len(rows) % queries:
        raise ValueError("queries have different numbers of results")
    shape = (queries, len(rows) // queries if queries else 0)
    out = create(found.sparkSession, path)
    out.write(bytearray(format_truth(np.array([r[2] for r in rows]).reshape(shape), np.array([r[3] for r in rows]).reshape(shape))))
    out.close()


def parse_range_truth(body: bytes) -> list[np.ndarray]:
    """Ids by query of a range truth file: counts first, then all ids."""
    n, total = struct.unpack_from("<ii", body)
    size = np.frombuffer(body, "<u4", n, 8)
    if int(size.sum()) != total:
        raise ValueError("counts do not add up to the header's total")
    return np.split(np.frombuffer(body, "<u4", total, 8 + 4 * n), np.cumsum(size)[:-1])


def parse_graph(body: bytes) -> tuple[int, int, list[np.ndarray]]:
    """(start, frozen points, neighbour lists) of a graph file."""
    size, _, start, frozen = struct.unpack_from("<QIIQ", body)
    at, lists = 24, []
    while at < min(size, len(body)):
        n = struct.unpack_from("<I", body, at)[0]
        lists.append(np.frombuffer(body, "<u4", n, at + 4))
        at += 4 + 4 * n
    return start, frozen, lists


def format_graph(lists: list[np.ndarray], start: int, frozen: int = 0) -> bytes:
    rows = b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<u4").tobytes() for r in lists)
    return struct.pack("<QIIQ", 24 + len(rows), max(map(len, lists), default=0), start, frozen) + rows


def write_graph(edges: DataFrame, path: str, start: int, frozen: int = 0) -> None:
    """(src, nbrs), src from 0 on without gaps, as a graph file; rows pass the driver one partition at a time."""
    spark = edges.sparkSession
    size = edges.agg(F.sum(4 + 4 * F.size("nbrs")), F.max(F.size("nbrs"))).first()
    out = create(spark, path)
    out.write(bytearray(struct.pack("<QIIQ", 24 + (size[0] or 0), size[1] or 0, start, frozen)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("nbrs").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<u4").tobytes() for r in rows)], pa.binary())], ["body"])

    for r in edges.select("src", "nbrs").repartitionByRange(1, "src").sortWithinPartitions("src").mapInArrow(run, "body binary").toLocalIterator():
        out.write(bytearray(r["body"]))
    out.close()


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, nbrs, is_start) of a graph file, parsed by one task: lists have no fixed width, so the file cannot be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("content").to_pylist():
                start, _, lists = parse_graph(body)
                for lo in range(0, len(lists), PIECE):
                    some = lists[lo : lo + PIECE]
                    src = np.arange(lo, lo + len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array([x.astype(np.int64) for x in some], pa.list_(pa.int64())), pa.array(src == start)], ["src", "nbrs", "is_start"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src long, nbrs array<long>, is_start boolean")


def checked_tags(points: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, tag) joined; raises where points and tags differ in number."""
    n, m = points.count(), tags.count()
    if n != m:
        raise ValueError(f"{n} points but {m} tags")
    return points.join(tags, "id")

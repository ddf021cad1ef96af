"""Session helpers shared by the training-data operators: shared scratch tables, fold flags, bounded samples, Arrow blocks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the numpy kernels: bounds a Python worker's memory (a longer document is a block by itself).
BLOCK_BYTES = 1 << 19

#: Text bytes that one bucket or one group of chunks should hold in the lookups of ``exchange``: their number follows the input.
SHARE_BYTES = 16 << 20

_scratch: list[tuple[SparkSession, str]] = []
_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one (tests);
    a cluster gets an error, since no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="quiverlake-")
    return _local_dirs[context.applicationId]


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back, so a lost executor loses nothing.

    ``by``: a column whose values become folders of their own, which ``dropped`` can remove one by one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quiverlake/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(table: DataFrame, folder: str = "") -> None:
    """Removes a written table, or one folder of it, that no later step reads."""
    delete(table.sparkSession, f"{table.scratch_path}/{folder}" if folder else table.scratch_path)


def settled(table: DataFrame) -> DataFrame:
    """A written table; the shuffles of the finished steps, which only exist for those, are left to Spark's cleaner at once."""
    gc.collect()
    table.sparkSession.sparkContext._jvm.System.gc()
    return table


def release_scratch() -> None:
    """Deletes the scratch tables of this process; called at exit, or by hand once results are stored."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may already be stopped at exit
            break
    while _local_dirs:
        shutil.rmtree(_local_dirs.popitem()[1], ignore_errors=True)


atexit.register(release_scratch)


def shares(docs: DataFrame, column: str = "text", per: int = SHARE_BYTES) -> int:
    """How many shares of ``per`` bytes all values of ``column`` make; at least the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // per))


def fold(doc_id: str | Column, mod: int, remainder: int) -> Column:
    """True for rows whose crc32(doc_id as text) mod ``mod`` is ``remainder``; a null id is in no such fold."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % F.lit(mod) == F.lit(remainder), F.lit(False))


def bounded_rows(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows in the order of a seeded hash of ``key``: the same rows however the data are partitioned.

    ``key`` has distinct values. Rows beyond a hash that some twice ``bound`` rows lie below are left out first, so that tasks sort
    and send their share of the bound and not each the whole of it.
    """
    hashed = df.withColumn("_order", F.xxhash64(F.lit(seed), F.col(key)))
    n = df.count()
    least, most = -(1 << 63), (1 << 63) - 1
    below = hashed
    if n > 4 * bound:
        cut = least + int(2 * (bound + 100) / n * (1 << 64))
        below = hashed.where(F.col("_order") <= min(cut, most))
    return below.orderBy("_order", F.col(key)).limit(bound).drop("_order")


def labelled_sample(labels: DataFrame, column: str, keep: Column, bound: int, seed: int) -> list[tuple[int, int]]:
    """(doc_id, label) of at most ``bound`` rows of each class 0 and 1. One label per document: the larger where rows disagree."""
    clean = labels.where(keep & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    found: dict[int, int] = {}
    for value in (0, 1):
        rows = bounded_rows(clean.where(F.col(column) == value).select("doc_id").distinct(), "doc_id", bound, seed).collect()
        found |= {int(r[0]): value for r in rows}
    return sorted(found.items())


def sampled_texts(docs: DataFrame, sample: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, label, text) of a bounded sample. The sample's size is bounded by its maker, so it is broadcast."""
    spark = docs.sparkSession
    ids = spark.createDataFrame(sample or [], "doc_id long, label int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` holds at most ``most`` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type, from_pandas=False) for f in schema], schema=schema)

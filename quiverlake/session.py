"""Session helpers: a tuned session for local use, and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quiverlake")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_code(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers once an application, so that they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quiverlake-code-")
        atexit.register(shutil.rmtree, folder, True)
        target = os.path.join(folder, "quiverlake_code.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one, which goes
    when the process ends; a cluster gets an error, since no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="quiverlake-")
        atexit.register(shutil.rmtree, _local_dirs[context.applicationId], True)
    return _local_dirs[context.applicationId]


def persisted(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quiverlake/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

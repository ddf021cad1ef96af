"""Streams of inserts and deletes into a log of snapshots, and running counts of changes in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_changes(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream of (id, op, vec, seq) to the change log. The file sink and its checkpoint make a repeated batch harmless."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec): the last change of each id by ``seq``, deletions left out."""
    log = spark.read.parquet(path)
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return log.withColumn("r", F.row_number().over(w)).where("r = 1 and op <> 'delete'").select("id", "vec")


def change_counts(stream: DataFrame, time: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, op, n): changes by window of event time; later rows than the watermark are dropped by definition."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "op").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "op", "n")

"""Generated vectors and labels, and reproducible slices. All draws are hashes of ids and a seed, so partitions do not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v


def uniform(seed: int, *parts: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)


def vectors(spark: SparkSession, n: int, dim: int, norm: float, kind: str = "float", seed: int = 1) -> DataFrame:
    """(id, vec): normal directions of a given norm; kind int8 truncates, uint8 adds 128 first."""
    normal = lambda i: F.sqrt(-2 * F.log(uniform(seed, F.col("id"), i))) * F.cos(2 * F.pi() * uniform(seed + 1, F.col("id"), i))
    raw = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), normal).alias("raw"))
    vec = F.transform(v.scaled(F.col("raw"), v.norm(F.col("raw"))), lambda x: x * norm)
    if kind == "int8":
        vec = F.transform(vec, lambda x: F.least(F.greatest(x, F.lit(-128.0)), F.lit(127.0)).cast("int").cast("double"))
    elif kind == "uint8":
        vec = F.transform(vec, lambda x: F.least(F.greatest(x + 128, F.lit(0.0)), F.lit(255.0)).cast("int").cast("double"))
    elif kind != "float":
        raise ValueError(f"unknown kind {kind}")
    return raw.select("id", vec.alias("vec"))


def zipf_labels(spark: SparkSession, n: int, labels: int, factor: float = 0.7, seed: int = 1) -> DataFrame:
    """(id, labels): label i with probability 1 / i ** factor; ["0"] where none is drawn."""
    drawn = F.filter(F.sequence(F.lit(1), F.lit(labels)), lambda i: uniform(seed, F.col("id"), i) < 1 / F.pow(i, F.lit(factor)))
    names = F.transform(drawn, lambda i: i.cast("string"))
    return spark.range(n).select("id", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("0"))).alias("labels"))


def random_labels(spark: SparkSession, n: int, labels: int, share: float = 0.5, seed: int = 1) -> DataFrame:
    """(id, labels): each label with the same probability."""
    drawn = F.filter(F.sequence(F.lit(1), F.lit(labels)), lambda i: uniform(seed, F.col("id"), i) < share)
    names = F.transform(drawn, lambda i: i.cast("string"))
    return spark.range(n).select("id", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("0"))).alias("labels"))


def one_label(spark: SparkSession, n: int, labels: int) -> DataFrame:
    return spark.range(n).select("id", F.array((F.col("id") % labels + 1).cast("string")).alias("labels"))


def sampled_query_labels(points: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(qid, label): n labels drawn evenly over all (point, label) pairs, by the order of a seeded hash."""
    pairs = points.select("id", F.explode("labels").alias("label")).orderBy(F.xxhash64(F.lit(seed), "id", "label"), "id", "label").limit(n)
    return pairs.select(F.monotonically_increasing_id().alias("qid"), "label")


def bernoulli(points: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Rows whose multiplicative hash of the id falls under the share."""
    return points.where(F.pmod((F.col("id") + 1 + seed) * F.lit(2654435761), F.lit(1 << 32)) < share * (1 << 32))

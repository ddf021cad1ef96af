"""Label sets of points: encoding, lookups, statistics, inverted index, breaking up dense points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import persisted


def parse(lines: DataFrame, line: str = "line", sep: str = ",") -> DataFrame:
    """(id, labels) from (id, line): what stands before a tab, split, trimmed, without empty labels."""
    head = F.split(F.coalesce(F.col(line), F.lit("")), "\t")[0]
    return lines.select("id", F.filter(F.transform(F.split(head, sep), lambda x: F.trim(x)), lambda x: x != "").alias("labels"))


def encode(points: DataFrame, universal: str | None = None) -> DataFrame:
    """(label, code) of (id, labels): codes in order of first sight (by id, then place). A universal label is 0 and shifts the rest to 2."""
    first = points.select("id", F.posexplode("labels").alias("place", "label")).groupBy("label").agg(F.min(F.struct("id", "place")).alias("seen"))
    shift = 0
    if universal is not None:
        first, shift = first.where(F.col("label") != universal), 1
    # one row for each distinct label: the window runs over the label map, not over the points
    codes = first.select("label", (F.row_number().over(Window.orderBy("seen")) + shift).alias("code"))
    if universal is None:
        return codes
    return codes.unionByName(points.sparkSession.createDataFrame([(universal, 0)], "label string, code int"))


def lookup(wanted: DataFrame, codes: DataFrame, universal: str | None = None) -> DataFrame:
    """(qid, label, code); an unknown label gets the universal code 0, or raises where there is none."""
    unknown = F.lit(0) if universal is not None else F.raise_error(F.concat(F.lit("unknown label "), F.col("label"))).cast("int")
    return wanted.join(codes, "label", "left").select("qid", "label", F.coalesce("code", unknown).alias("code"))


def counts(points: DataFrame) -> DataFrame:
    """(label, n): points by label."""
    return points.select("id", F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def statistics(points: DataFrame, dense: int = 10) -> DataFrame:
    """One row: points, labels, labels a point, the share of points with over ``dense`` labels, the largest label's points."""
    per_point = points.agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.size("labels")).alias("labels_per_point"), F.avg((F.size("labels") > dense).cast("double")).alias("dense_share")
    )
    few = counts(points).agg(F.count(F.lit(1)).alias("labels"), F.max("n").alias("largest"), F.avg("n").alias("points_per_label")).first()
    return per_point.select("*", F.lit(few["labels"]).cast("long").alias("labels"), F.lit(few["largest"]).cast("long").alias("largest"), F.lit(few["points_per_label"]).cast("double").alias("points_per_label"))


def inverted(points: DataFrame, universal: str | int | None = None) -> DataFrame:
    """(label, id); a point with the universal label belongs to every label."""
    pairs = points.select("id", F.explode(F.array_distinct("labels")).alias("label"))
    if universal is None:
        return pairs.select("label", "id")
    ordinary = pairs.where(F.col("label") != universal)
    every = ordinary.select("label").distinct()
    wild = pairs.where(F.col("label") == universal).select("id")
    # the output itself is |universal points| * |labels|; every label is a stated key here
    labels = every.agg(F.collect_set("label").alias("all"))
    spread = wild.join(labels).select("id", F.explode("all").alias("label"))
    return ordinary.select("label", "id").unionByName(spread.select("label", "id")).distinct()


def broken_up(points: DataFrame, density: int, start: int) -> DataFrame:
    """(id, origin, labels): each group of ``density`` labels of a point is a point of its own; copies get ids from ``start`` on.

    Copies are numbered in order of their points by range partitions and their offsets.
    """
    from .graphs import dense_numbers

    groups = F.ceil(F.size("labels") / F.lit(density))
    many = points.where(F.size("labels") > density)
    copies = many.select("id", F.explode(F.sequence(F.lit(1), groups.cast("int") - 1)).alias("g")).select(F.struct("id", "g").alias("old"))
    numbered = dense_numbers(copies).select("old.id", "old.g", (F.col("new") + F.lit(start)).alias("copy"))
    cut = points.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(groups.cast("int") - 1, F.lit(0))), lambda g: F.slice("labels", g * density + 1, density))).alias("g", "part"))
    named = cut.join(numbered, ["id", "g"], "left")
    return named.select(F.coalesce("copy", "id").cast("long").alias("id"), F.col("id").alias("origin"), F.col("part").alias("labels"))


def size_report(points: DataFrame, steps: int = 20, top: int = 3) -> DataFrame:
    """(kind, place, value, label): the points of a label at each 5 per cent (kind percent), and those of the largest labels (kind top)."""
    from .evaluate import percentiles

    sizes = persisted(counts(points))
    wanted = [100 * i // steps for i in range(steps + 1)]
    spread = percentiles(sizes, "n", "label", wanted).select(F.lit("percent").alias("kind"), F.col("percent").alias("place"), F.col("value").cast("long").alias("value"), F.lit(None).cast("string").alias("label"))
    best = sizes.orderBy(F.desc("n"), "label").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "label"))
    return spread.unionByName(best.select(F.lit("top").alias("kind"), place.alias("place"), F.col("n").alias("value"), "label"))


def of_shards(points: DataFrame, owner: DataFrame) -> DataFrame:
    """(shard, id, label): the labels of each shard's points; owner: (id, shard)."""
    return owner.join(points.select("id", F.explode(F.array_distinct("labels")).alias("label")), "id").select("shard", "id", "label")


def read_map(spark, path: str) -> DataFrame:
    """(label, code) of lines ``label TAB code``."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(parts[0].alias("label"), parts[1].cast("int").alias("code"))


def write_map(codes: DataFrame, path: str) -> None:
    codes.orderBy("code").select(F.concat_ws("\t", "label", F.col("code").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_filters(spark, path: str) -> DataFrame:
    """(qid, label) of a file with one label a line, numbered in file order; query files are stated sets, read by one task."""
    return spark.sparkContext.textFile(path, 1).zipWithIndex().toDF(["label", "qid"]).select(F.col("qid").cast("long").alias("qid"), F.trim("label").alias("label"))

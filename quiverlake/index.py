"""A vector index of snapshots: build, search, insert, delete, repair, consolidate, write and read.

State is tables: points (id, vec, labels, shard), edges (shard, src, nbrs, is_start), tombstones (id), and fresh points (id, vec, labels)
that are searched exactly until they are linked or consolidated. Every change makes a new snapshot; nothing is updated in place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import vectors as v
from .operators import clusters, graphs, knn
from .session import persisted, ship_code


@dataclass(frozen=True)
class Parameters:
    """``most_points``: the largest shard; ``overlap``: the shards of a point; ``frozen``: extra start nodes, spread over each shard."""

    degree: int = 32
    width: int = 64
    alpha: float = graphs.ALPHA
    most_points: int = graphs.SHARD_POINTS
    overlap: int = 1
    metric: str = "l2"
    seed: int = 1
    universal_label: str | None = None
    filtered: bool = False
    frozen: int = 0


@dataclass(frozen=True)
class VectorIndex:
    points: DataFrame
    edges: DataFrame
    tombstones: DataFrame
    fresh: DataFrame
    parameters: Parameters

    @classmethod
    def build(cls, table: DataFrame, id_col: str = "id", vec_col: str = "vec", label_col: str | None = None, parameters: Parameters | None = None) -> VectorIndex:
        """Partitions, then builds each shard in a task. Null vectors are rejected, as are vectors of several lengths."""
        p = parameters or Parameters()
        if p.metric not in ("l2", "cosine", "ip"):
            raise ValueError(f"unknown metric {p.metric}")
        if p.filtered and label_col is None:
            raise ValueError("a filtered index needs labels")
        spark = ship_code(table.sparkSession)
        labels = F.col(label_col) if label_col else F.array().cast("array<string>")
        points = persisted(table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), labels.alias("labels")))
        bad = points.agg(F.count(F.when(F.col("vec").isNull(), 1)).alias("none"), F.count_distinct(F.size("vec")).alias("sizes"), F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("n")).first()
        if bad["none"] or bad["sizes"] > 1 or bad["ids"] != bad["n"]:
            raise ValueError("ids must be unique, vectors not null and of one length")
        # points are dealt to shards by their direction where distances look at directions only
        near = points.withColumn("vec", v.normalized(F.col("vec"))) if p.metric == "cosine" else points
        owner = clusters.partition_under(near, p.most_points, p.overlap, p.seed)[1] if bad["n"] else spark.createDataFrame([], "id long, shard long")
        sharded = persisted(points.join(owner, "id"))
        if p.filtered:
            edges = graphs.build_filtered(sharded, p.degree, p.width, p.alpha, p.universal_label, p.metric)
        else:
            edges = graphs.build(sharded, p.degree, p.width, p.alpha, p.metric)
        if p.frozen:
            spread = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(p.seed), "src"), "src")
            edges = edges.withColumn("is_start", F.col("is_start") | (F.row_number().over(spread) <= p.frozen))
        return cls(sharded, persisted(edges), spark.createDataFrame([], "id long"), points.limit(0), p)

    def search(self, queries: DataFrame, k: int, width: int | None = None, label: str | None = None) -> DataFrame:
        """(qid, rank, id, dist): deleted points lead the way and are no results, fresh points are searched exactly. queries: (id, vec).

        A width under k, and a label that no point has, raise.
        """
        p = self.parameters
        if width is not None and k > width:
            raise ValueError("k must not be larger than the list width")
        width = width or max(p.width, 2 * k)
        some = self.fresh
        if label is not None:
            carries = F.array_contains("labels", label)
            some = self.fresh.where(carries if p.universal_label is None else carries | F.array_contains("labels", p.universal_label))
        exact = knn.knn(some.select("id", "vec"), queries, k, p.metric).select("qid", "id", "dist")
        if label is not None and self.points.where(F.array_contains("labels", label)).isEmpty() and not some.isEmpty():
            return knn.ranked(exact, k)
        gone = None if self.tombstones.isEmpty() else self.tombstones
        found = graphs.search(self.points, self.edges, queries, k, width, label, p.metric, p.universal_label, gone)
        return knn.ranked(found.select("qid", "id", "dist").unionByName(exact), k)

    def search_with_vectors(self, queries: DataFrame, k: int, width: int | None = None, label: str | None = None) -> DataFrame:
        """(qid, rank, id, dist, vec): results with their vectors."""
        return self.search(queries, k, width, label).join(self.vectors().select("id", "vec"), "id").select("qid", "rank", "id", "dist", "vec")

    def insert(self, table: DataFrame) -> tuple[VectorIndex, DataFrame]:
        """(index, rejected ids): (id, vec, labels) rows whose id is not active yet; of rows with one id any one is taken.

        An id that was deleted may come again: its old vector leaves the points and its tombstone goes; the graph is repaired around it.
        """
        new = table.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), "labels").where("id is not null and vec is not null").dropDuplicates(["id"])
        there = self.ids()
        rejected = persisted(new.select("id").join(there, "id", "left_semi"))
        taken = persisted(new.join(there, "id", "left_anti"))
        again = persisted(taken.select("id").join(self.tombstones, "id", "left_semi"))
        index = self
        if not again.isEmpty():
            index = replace(self, tombstones=again).repair()
            rest = persisted(self.tombstones.join(again, "id", "left_anti"))
            index = replace(index, tombstones=rest, fresh=self.fresh.join(again, "id", "left_anti"))
        return replace(index, fresh=persisted(index.fresh.unionByName(taken))), rejected

    def link(self) -> VectorIndex:
        """Fresh points become nodes: each goes to the shard whose start is nearest and is linked there, in order of the ids."""
        p = self.parameters
        if self.fresh.isEmpty():
            return self
        if self.edges.isEmpty():
            return VectorIndex.build(self.vectors(), label_col="labels", parameters=p)
        one = Window.partitionBy("shard").orderBy("src")
        starts = self.edges.where("is_start").withColumn("r", F.row_number().over(one)).where("r = 1").select("shard", F.col("src").alias("id")).join(self.points.select("shard", "id", "vec"), ["shard", "id"])
        new = persisted(self.fresh.join(self.tombstones, "id", "left_anti"))
        numbered = starts.select(F.col("shard").alias("centre"), "vec")
        owner = clusters.nearest(new, numbered).select("id", F.col("centre").alias("shard"))
        placed = persisted(new.join(owner, "id"))
        edges = persisted(graphs.inserted(self.points, self.edges, placed, p.degree, p.width, p.alpha, p.metric))
        return replace(self, points=persisted(self.points.unionByName(placed.select(*self.points.columns))), edges=edges, fresh=self.fresh.limit(0))

    def delete(self, ids: DataFrame) -> tuple[VectorIndex, DataFrame]:
        """(index, failed ids): marks points; the graph stays until it is repaired or consolidated."""
        there = self.ids()
        wanted = ids.select(F.col("id").cast("long").alias("id")).distinct()
        failed = persisted(wanted.join(there, "id", "left_anti"))
        gone = persisted(wanted.join(there, "id", "left_semi"))
        fresh = persisted(self.fresh.join(gone, "id", "left_anti"))
        marked = gone.join(self.points.select("id").distinct(), "id", "left_semi")
        return replace(self, fresh=fresh, tombstones=persisted(self.tombstones.unionByName(marked).distinct())), failed

    def ids(self) -> DataFrame:
        """Active ids."""
        return self.points.select("id").distinct().join(self.tombstones, "id", "left_anti").unionByName(self.fresh.select("id"))

    def vectors(self) -> DataFrame:
        """(id, vec, labels) of the active points."""
        linked = self.points.select("id", "vec", "labels").dropDuplicates(["id"]).join(self.tombstones, "id", "left_anti")
        return linked.unionByName(self.fresh.select("id", "vec", "labels"))

    def consolidate(self) -> tuple[VectorIndex, dict[str, int]]:
        """(index, report): a new snapshot without tombstones and with fresh points in the graph; every shard is rebuilt from its live vectors.

        The report counts the points before, deleted, added and after.
        """
        before, gone, added = self.points.select("id").distinct().count(), self.tombstones.count(), self.fresh.count()
        index = VectorIndex.build(self.vectors(), label_col="labels", parameters=self.parameters)
        return index, {"before": before, "deleted": gone, "added": added, "after": index.points.select("id").distinct().count()}

    def repair(self) -> VectorIndex:
        """Takes tombstones out of the graph: deleted neighbours are replaced by theirs, lists above the degree are pruned; all shards at once.

        Shards whose start was deleted get their smallest live node as start.
        """
        p = self.parameters
        live = persisted(self.points.join(self.tombstones, "id", "left_anti"))
        fixed = graphs.pruned(graphs.repaired(self.edges, self.tombstones, ["shard"]), live, p.degree, p.alpha, p.metric, ["shard"])
        kept = [c for c in ("is_start", "starts_label") if c in self.edges.columns]
        named = fixed.join(self.edges.select("shard", "src", *kept), ["shard", "src"])
        first = Window.partitionBy("shard").orderBy(F.col("is_start").desc(), "src")
        edges = named.withColumn("is_start", F.col("is_start") | (F.row_number().over(first) == 1)).select(*self.edges.columns)
        return replace(self, points=live, edges=persisted(edges), tombstones=self.tombstones.limit(0))

    def status(self) -> dict[str, int]:
        return {"active": self.ids().count(), "indexed": self.points.select("id").distinct().count(), "fresh": self.fresh.count(), "deleted": self.tombstones.count()}

    def write(self, path: str) -> None:
        for name in ("points", "edges", "tombstones", "fresh"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.points.sparkSession
        spark.createDataFrame([(json.dumps(self.parameters.__dict__), self.points.count(), self.edges.count())], "parameters string, points long, edges long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        """Raises where the tables do not have the numbers of rows of the manifest."""
        ship_code(spark)
        manifest = spark.read.schema("parameters string, points long, edges long").json(f"{path}/manifest").first()
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("points", "edges", "tombstones", "fresh")}
        if (tables["points"].count(), tables["edges"].count()) != (manifest["points"], manifest["edges"]):
            raise ValueError("the tables do not belong to the manifest")
        stored, known = json.loads(manifest["parameters"]), {f.name for f in fields(Parameters)}
        return cls(**tables, parameters=Parameters(**{k: x for k, x in stored.items() if k in known}))

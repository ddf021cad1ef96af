"""Whole builds: from vectors and a memory budget to a graph, codes, hash buckets and pages."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import clusters, graphs, hashing, labels, pages, quantization
from ..session import persisted, ship_code
from . import planner


@dataclass(frozen=True)
class PageIndex:
    """Tables of a page index, and what the budget gave. Searches prepare queries as the build prepared points."""

    pages: DataFrame
    mapping: DataFrame
    codes: DataFrame
    book: quantization.Codebook
    buckets: DataFrame
    planes: list[list[float]]
    per_page: int
    page_degree: int
    routed_share: float
    cached_share: float
    cache: str
    metric: str = "l2"
    largest_norm: float = 1.0
    labels: DataFrame | None = None

    def prepared_queries(self, queries: DataFrame) -> DataFrame:
        """Queries in the space of the build: of unit length for cosine, with a zero behind for inner products."""
        if self.metric == "cosine":
            return queries.withColumn("vec", v.normalized(F.col("vec")))
        return queries.withColumn("vec", v.mips_query(F.col("vec"))) if self.metric == "ip" else queries

    def entries(self, queries: DataFrame, radius: int = 1, cap: int = hashing.ENTRY_CAP) -> dict[int, list[int]]:
        """Entry nodes of each of the stated queries, from the hash buckets; none where no bucket is met."""
        hashed = hashing.hashes(queries, self.planes).withColumnRenamed("id", "qid")
        found = hashing.entry_points(self.buckets, hashed, len(self.planes), radius, -1, cap).where("id >= 0").groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        return {r["qid"]: list(r["ids"]) for r in found.collect()}

    def read_log(self, queries: DataFrame, k: int, width: int, beam: int = 4, most_pages: int | None = None, radius: int | None = None, keep_label: str | None = None) -> DataFrame:
        """The log of a search: results, hops and pages read. ``radius``: entry nodes from hash buckets within so many flips."""
        queries = persisted(self.prepared_queries(queries.select("id", "vec")))
        entries = None if radius is None else self.entries(queries, radius)
        return pages.read_log(self.pages, queries, k, width, beam, most_pages, entries, self.book, keep_label=keep_label, labels=self.labels)

    def search(self, queries: DataFrame, k: int, width: int, **options) -> DataFrame:
        """(qid, rank, id, dist): distances are those of the metric."""
        found = pages.results(self.read_log(queries, k, width, **options), k)
        if self.metric == "cosine":
            return found.withColumn("dist", F.col("dist") / 2)
        if self.metric == "ip":
            # |p / M - q / |q||^2 with the augmented length 1 is 2 - 2 p.q / (M |q|)
            norms = queries.select(F.col("id").alias("qid"), v.norm(F.col("vec")).alias("norm"))
            return found.join(F.broadcast(norms), "qid").select("qid", "rank", "id", ((F.col("dist") - 2) / 2 * F.lit(self.largest_norm) * F.col("norm")).alias("dist"))
        return found

    def cache_pages(self, sample: DataFrame, width: int, share: float | None = None) -> DataFrame:
        """(page_id, n): the pages that a sample of queries reads most, as many as the budget's share of all pages."""
        log = persisted(self.read_log(sample, 1, width))
        return pages.visits(log, int((self.cached_share if share is None else share) * self.pages.count()))

    _TABLES = ("pages", "mapping", "codes", "buckets")
    _VALUES = ("per_page", "page_degree", "routed_share", "cached_share", "cache", "metric", "largest_norm")

    def write(self, path: str) -> None:
        """Tables as Parquet, the codebook, the planes and a manifest with the numbers of rows."""
        spark = self.pages.sparkSession
        for name in self._TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        if self.labels is not None:
            self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        quantization.codebook_frame(spark, self.book).coalesce(1).write.mode("overwrite").parquet(f"{path}/book")
        hashing.planes_frame(spark, self.planes).coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")
        stored = {k: getattr(self, k) for k in self._VALUES} | {"labels": self.labels is not None}
        spark.createDataFrame([(json.dumps(stored), self.pages.count(), self.codes.count())], "parameters string, pages long, codes long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PageIndex:
        """Raises where the tables do not have the numbers of rows of the manifest."""
        ship_code(spark)
        manifest = spark.read.schema("parameters string, pages long, codes long").json(f"{path}/manifest").first()
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in cls._TABLES}
        if (tables["pages"].count(), tables["codes"].count()) != (manifest["pages"], manifest["codes"]):
            raise ValueError("the tables do not belong to the manifest")
        values = json.loads(manifest["parameters"])
        labelled = spark.read.parquet(f"{path}/labels") if values.pop("labels") else None
        return cls(**tables, book=quantization.codebook_of(spark.read.parquet(f"{path}/book")), planes=hashing.planes_of(spark.read.parquet(f"{path}/planes")), labels=labelled, **values)


def prepared(points: DataFrame, metric: str) -> DataFrame:
    """Vectors for an L2 build: as they are, of unit length for cosine, augmented for inner products."""
    if metric == "cosine":
        return points.withColumn("vec", v.normalized(F.col("vec")))
    if metric == "ip":
        largest = points.agg(F.max(v.norm(F.col("vec")))).first()[0] or 1.0
        return points.withColumn("vec", v.mips_augmented(F.col("vec"), F.lit(float(largest))))
    if metric != "l2":
        raise ValueError(f"unknown metric {metric}")
    return points


def broken_dense(points: DataFrame, density: int) -> DataFrame:
    """(id, vec, labels): points with more labels than ``density`` as several, the copies with new ids above all."""
    start = (points.agg(F.max("id")).first()[0] or 0) + 1
    parts = labels.broken_up(points.select("id", "labels"), density, start)
    return parts.join(points.select(F.col("id").alias("origin"), "vec"), "origin").select("id", "vec", "labels")


def build_page_index(
    points: DataFrame, budget_gb: float, chunks: int, least_degree: int, metric: str = "l2", most_points: int = graphs.SHARD_POINTS, width: int = 100, alpha: float = graphs.ALPHA,
    bits: int = hashing.PLANES, seed: int = 1, rotated: bool = False, coded_build: bool = False, page_chunks: int = 0,
) -> PageIndex:
    """Plans by the budget, then builds. Raises where the budget is below the least or a page holds no vector.

    points: (id, vec[, labels]). ``rotated``: the codebook with a trained rotation. ``coded_build``: the graph is built on decoded codes.
    ``page_chunks``: pages hold codes of so many bytes instead of vectors, by a plain codebook of their own; distances are then those of the codes.
    """
    ship_code(points.sparkSession)
    labelled = persisted(points.select("id", "labels")) if "labels" in points.columns else None
    largest = points.agg(F.max(v.norm(F.col("vec")))).first()[0] or 1.0
    points = persisted(prepared(points.select("id", "vec"), metric))
    n, dim = points.count(), points.select(F.size("vec")).first()[0]
    routed, cached = planner.cache_shares(budget_gb, chunks, n)
    if cached < 0:
        raise ValueError(f"a budget of {budget_gb} GB is below the least of {planner.RESERVED_MB} MB")
    page_degree, per_page = planner.page_layout(dim, 4, chunks, cached, least_degree)
    if not per_page:
        raise ValueError("a page holds no vector at this degree")
    degree = planner.recommended_degree(dim, 4, chunks, cached, least_degree)
    book = quantization.fit(points, min(chunks, dim), min(quantization.CENTRES, n), rotated, seed=seed)
    sharded = clusters.sharded_under(points, most_points, 1, seed)
    edges = persisted(graphs.build(sharded, degree, width, alpha, book=book if coded_build else None))
    held = sharded
    if page_chunks:
        own = quantization.fit(points, min(page_chunks, dim), min(quantization.CENTRES, n), seed=seed)
        held = sharded.drop("vec").join(quantization.restored(points, own), "id")
    width_bytes = planner.ID_BYTES + (0 if cached >= 1 else chunks)
    spare = planner.spare_bytes(dim, 4, page_degree, per_page, chunks, cached)
    paged = persisted(pages.build(held, edges, per_page, page_degree, None, width_bytes, spare))
    planes = hashing.random_planes(dim, bits, seed)
    kept = points if routed >= 1 else points.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(routed * (1 << 20)))
    return PageIndex(
        paged, persisted(pages.id_map(paged, per_page)), persisted(quantization.encode(points, book)), book, persisted(hashing.buckets(hashing.hashes(kept, planes))), planes,
        per_page, page_degree, routed, cached, planner.cache_plan(int(cached * n), n, chunks), metric, float(largest), labelled,
    )

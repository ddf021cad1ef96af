"""The registered queries of the vector engine, and the SQL that gives the same rows on the same tables.

All queries run over the whole ``embeddings`` table. Vectors are scaled by 1 + vec_id % 7, so that metrics disagree; the stated query set
is every row whose vec_id is divisible by 50. Distances are rounded to six digits on both sides. Centres, codebooks and planes that SQL
must know too are the first vectors of the table: parameters of a stated size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import clusters, graphs, hashing, knn, labels, pages, quantization
from ..sources import generators
from . import planner

K = 10
#: Every row whose id this divides is a query.
QUERY_STEP = 50
BITS = 8

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        _queries[name] = run
        if sql is not None:
            _sql[name] = sql
        return run

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---- the tables as both engines see them ----


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label, labels)."""
    scale = 1 + F.col("vec_id") % 7
    return raw(spark, sf_dir).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("vec"), "label",
        F.array(F.col("label").cast("string"), (100 + F.col("vec_id") % 3).cast("string")).alias("labels"),
    )


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(F.col("id") % QUERY_STEP == 0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


BASE = "b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS vec, label, [label::VARCHAR, (100 + vec_id % 3)::VARCHAR] AS labels FROM embeddings)"
QUERIES = f"q AS (SELECT id AS qid, vec AS qvec, label AS qlabel FROM b WHERE id % {QUERY_STEP} = 0)"


def _sum(a: str, b: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {term}))"


def sql_l2(a: str, b: str) -> str:
    return _sum(a, b, "(p[1] - p[2]) * (p[1] - p[2])")


def sql_dot(a: str, b: str) -> str:
    return _sum(a, b, "p[1] * p[2]")


def sql_cosine(a: str, b: str) -> str:
    return f"1 - {sql_dot(a, b)} / (sqrt({sql_dot(a, a)}) * sqrt({sql_dot(b, b)}))"


def sql_knn(dist: str, where: str = "true", k: int = K) -> str:
    return f"""WITH {BASE}, {QUERIES}, d AS (SELECT qid, id, {dist} AS dist FROM q, b WHERE {where}),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, id, dist FROM d)
SELECT qid, rank::INTEGER AS rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {k}"""


# ---- joins: nearest neighbours ----

for _metric, _dist in (("l2", sql_l2("qvec", "vec")), ("ip", "-" + sql_dot("qvec", "vec")), ("cosine", sql_cosine("qvec", "vec"))):
    query(f"knn_{_metric}", sql_knn(_dist))(lambda spark, d, m=_metric: rounded(knn.knn(base(spark, d), stated(spark, d), K, m), "dist"))


@query("knn_filtered", sql_knn(sql_l2("qvec", "vec"), "label = 3"))
def _knn_filtered(spark, d):
    return rounded(knn.knn_filtered(base(spark, d), stated(spark, d), K, F.col("label") == 3), "dist")


@query("knn_filtered_universal", sql_knn(sql_l2("qvec", "vec"), "list_contains(labels, '101') OR id % 50 = 0"))
def _knn_universal(spark, d):
    points = base(spark, d).withColumn("labels", F.when(F.col("id") % 50 == 0, F.concat("labels", F.array(F.lit("u")))).otherwise(F.col("labels")))
    keep = v.label_matches(F.col("labels"), F.array(F.lit("101")), F.lit("u"))
    return rounded(knn.knn_filtered(points, stated(spark, d), K, keep), "dist")


@query("knn_label_per_query", sql_knn(sql_l2("qvec", "vec"), "label = qlabel"))
def _knn_by_label(spark, d):
    q = stated(spark, d).select("id", "vec", F.col("label").cast("string").alias("label"))
    return rounded(knn.knn_by_label(base(spark, d), q, K), "dist")


@query("knn_in_parts", sql_knn(sql_l2("qvec", "vec")))
def _knn_parts(spark, d):
    """Partial results of parts of the base, merged: the parts are Spark's partitions here."""
    return rounded(knn.knn(base(spark, d).repartition(7), stated(spark, d), K), "dist")


@query("knn_range", f"WITH {BASE}, {QUERIES}, d AS (SELECT qid, id, {sql_l2('qvec', 'vec')} AS dist FROM q, b) SELECT qid, id, round(dist, 6) AS dist FROM d WHERE dist <= 4")
def _range(spark, d):
    return rounded(knn.within_range(base(spark, d), stated(spark, d), 4.0), "dist")


@query("knn_graph", f"""WITH {BASE}, d AS (SELECT a.id AS src, b.id AS dst, {sql_l2('a.vec', 'b.vec')} AS dist FROM b AS a, b AS b WHERE a.id <> b.id),
r AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS pos, dst, dist FROM d) SELECT src, pos::INTEGER AS pos, dst, round(dist, 6) AS dist FROM r WHERE pos <= 5""")
def _graph(spark, d):
    return rounded(graphs.knn_graph(base(spark, d), 5), "dist")


_RECALL = f"""WITH {BASE}, {QUERIES}, d AS (SELECT qid, id, {sql_l2('qvec', 'vec')} AS dist, {sql_cosine('qvec', 'vec')} AS other FROM q, b),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, row_number() OVER (PARTITION BY qid ORDER BY other, id) AS rank2 FROM d),
l AS (SELECT qid, dist AS lim FROM t WHERE rank = {K}),
x AS (SELECT t.qid, t.id, t.rank2 FROM t JOIN l USING (qid) WHERE (t.rank <= 20 AND (t.rank <= {K} OR t.dist = l.lim)))
SELECT round(100.0 * count(*) FILTER (WHERE rank2 <= {K}) / ({K} * (SELECT count(*) FROM q)), 6) AS recall FROM x"""


@query("recall_at_k", _RECALL)
def _recall(spark, d):
    truth = knn.knn(base(spark, d), stated(spark, d), 20)
    return rounded(knn.recall(truth, knn.knn(base(spark, d), stated(spark, d), K, "cosine"), K), "recall")


@query("recall_active", _RECALL.replace("FROM x", "FROM x WHERE x.id % 3 <> 0"))
def _recall_active(spark, d):
    """Only active ids of the result count."""
    truth = knn.knn(base(spark, d), stated(spark, d), 20)
    active = base(spark, d).where("id % 3 <> 0").select("id")
    found = knn.knn(base(spark, d), stated(spark, d), K, "cosine").join(active, "id", "left_semi")
    return rounded(knn.recall(truth, found, K), "recall")


# ---- projections ----


def each(name: str, column: Callable, sql: str) -> None:
    """A query that gives one array or number of every row, exploded and rounded."""
    query(f"vec_{name}", f"WITH {BASE}, t AS (SELECT id, {sql} AS a FROM b) SELECT id, unnest(range(len(a))) AS pos, round(unnest(a), 6) AS x FROM t")(
        lambda spark, d: rounded(base(spark, d).select("id", F.posexplode(column(F.col("vec"))).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x")
    )


_norm = f"sqrt({sql_dot('vec', 'vec')})"
each("normalized", v.normalized, f"list_transform(vec, lambda x: x / sqrt(1.1920929e-07 + {sql_dot('vec', 'vec')}))")
each("normalized_raw", v.normalized_raw, f"list_transform(vec, lambda x: x / {_norm})")
each("mips_query", v.mips_query, f"list_append(list_transform(vec, lambda x: x / {_norm}), 0.0)")
each("int8", lambda a: v.to_int8(a, 0.5, 8.0).cast("array<double>"), "list_transform(vec, lambda x: trunc(least(greatest((x - 0.5) * 254.0 / 8.0, -128), 127)))")
each("from_int8", lambda a: v.from_int8(v.to_int8(a, 0.0, 8.0), 1.0, 0.25), "list_transform(list_transform(vec, lambda x: trunc(least(greatest(x * 254.0 / 8.0, -128), 127))), lambda x: (x - 1.0) * 0.25)")
each("uint8", lambda a: v.to_uint8(F.transform(a, lambda x: F.abs(x * 1000))).cast("array<double>"), "list_transform(vec, lambda x: (trunc(abs(x * 1000))::BIGINT % 256)::DOUBLE)")


@query("vec_mips_augmented", f"WITH {BASE}, m AS (SELECT max({_norm}) AS m FROM b), t AS (SELECT id, list_append(list_transform(vec, lambda x: x / m), sqrt(greatest(0, 1 - {sql_dot('vec', 'vec')} / (m * m)))) AS a FROM b, m) SELECT id, unnest(range(len(a))) AS pos, round(unnest(a), 6) AS x FROM t")
def _mips(spark, d):
    points = base(spark, d)
    largest = points.agg(F.max(v.norm(F.col("vec")))).first()[0]
    return rounded(points.select("id", F.posexplode(v.mips_augmented(F.col("vec"), F.lit(largest))).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x")


@query("vec_norms", f"WITH {BASE} SELECT id, round({_norm}, 6) AS norm FROM b")
def _norms(spark, d):
    return rounded(base(spark, d).select("id", v.norm(F.col("vec")).alias("norm")), "norm")


@query("max_norm", f"WITH {BASE} SELECT round(max({_norm}), 6) AS max_norm FROM b")
def _max_norm(spark, d):
    return rounded(base(spark, d).agg(F.max(v.norm(F.col("vec"))).alias("max_norm")), "max_norm")


@query("fast_l2", sql_knn(f"{sql_dot('vec', 'vec')} - 2 * {sql_dot('vec', 'qvec')}"))
def _fast(spark, d):
    """Nearest by the distance without the query's own norm."""
    return rounded(knn.knn(base(spark, d), stated(spark, d), K, "fast_l2"), "dist")


@query("knn_normalized", f"""WITH {BASE.replace("b AS", "b0 AS", 1)}, b AS (SELECT id, list_transform(vec, lambda x: x / sqrt(1.1920929e-07 + {sql_dot('vec', 'vec')})) AS vec, label FROM b0), {QUERIES}, d AS (SELECT qid, id, {sql_l2('qvec', 'vec')} / 2 AS dist FROM q, b),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS rank, id, dist FROM d) SELECT qid, rank::INTEGER AS rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {K}""")
def _normalized(spark, d):
    """Cosine search by halved L2 over normalised vectors."""
    unit = lambda t: t.withColumn("vec", v.normalized(F.col("vec")))
    near = knn.knn(unit(base(spark, d)), unit(stated(spark, d)), 2 * K).select("qid", "id", F.round(F.col("dist") / 2, 9).alias("dist"))
    return rounded(knn.ranked(near, K), "dist")


@query("page_and_slot", f"WITH {BASE} SELECT id, id // 7 AS page_id, id % 7 AS slot FROM b")
def _page_slot(spark, d):
    return base(spark, d).select("id", v.page_of(F.col("id"), 7).alias("page_id"), v.slot_of(F.col("id"), 7).alias("slot"))


@query("sql_functions", f"WITH {BASE}, z AS (SELECT vec AS qvec FROM b WHERE id = 0) SELECT id, round({sql_l2('qvec', 'vec')}, 6) AS l2, round(-{sql_dot('qvec', 'vec')}, 6) AS ip, round({sql_cosine('qvec', 'vec')}, 6) AS cosine, round({_norm}, 6) AS norm FROM b, z")
def _functions(spark, d):
    """The registered SQL functions of every row and one fixed vector."""
    v.register(spark)
    points = base(spark, d)
    points.createOrReplaceTempView("quiverlake_points")
    fixed = ", ".join(repr(float(x)) + "D" for x in points.where("id = 0").first()["vec"])
    one = f"array({fixed})"
    return spark.sql(
        f"SELECT id, round(vec_l2({one}, vec), 6) AS l2, round(vec_ip({one}, vec), 6) AS ip, round(vec_cosine({one}, vec), 6) AS cosine, round(vec_norm(vec), 6) AS norm FROM quiverlake_points"
    )


# ---- labels ----


@query("label_codes", f"WITH {BASE}, e AS (SELECT id, unnest(labels) AS label, unnest([1, 2]) AS place FROM b), f AS (SELECT label, min(id * 10 + place) AS seen FROM e GROUP BY label) SELECT label, (row_number() OVER (ORDER BY seen))::INTEGER AS code FROM f")
def _codes(spark, d):
    return labels.encode(base(spark, d))


@query("label_lookup", f"WITH {BASE}, e AS (SELECT id, unnest(labels) AS label, unnest([1, 2]) AS place FROM b), f AS (SELECT label, min(id * 10 + place) AS seen FROM e WHERE label <> '101' GROUP BY label), c AS (SELECT label, (row_number() OVER (ORDER BY seen) + 1)::INTEGER AS code FROM f) SELECT qid, w.label, coalesce(code, 0)::INTEGER AS code FROM (SELECT vec_id AS qid, (vec_id % 13)::VARCHAR AS label FROM embeddings) w LEFT JOIN c ON c.label = w.label")
def _lookup(spark, d):
    wanted = base(spark, d).select(F.col("id").alias("qid"), (F.col("id") % 13).cast("string").alias("label"))
    return labels.lookup(wanted, labels.encode(base(spark, d), "101"), "101").select("qid", "label", "code")


@query("label_counts", f"WITH {BASE}, e AS (SELECT DISTINCT id, unnest(labels) AS label FROM b) SELECT label, count(*) AS n FROM e GROUP BY label")
def _label_counts(spark, d):
    return labels.counts(base(spark, d))


@query("label_statistics", f"WITH {BASE}, e AS (SELECT DISTINCT id, unnest(labels) AS label FROM b), c AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT (SELECT count(*) FROM b) AS points, round((SELECT avg(len(labels)) FROM b), 6) AS labels_per_point, (SELECT avg(CASE WHEN len(labels) > 1 THEN 1.0 ELSE 0.0 END) FROM b) AS dense_share, count(*) AS labels, max(n) AS largest, round(avg(n), 6) AS points_per_label FROM c")
def _label_stats(spark, d):
    return rounded(labels.statistics(base(spark, d), 1), "labels_per_point", "points_per_label")


_SIZES = "e AS (SELECT DISTINCT id, unnest(labels) AS label FROM b), c AS (SELECT label, count(*) AS n FROM e GROUP BY label)"


@query("label_sizes", f"WITH {BASE}, {_SIZES}, r AS (SELECT n, row_number() OVER (ORDER BY n, label) - 1 AS k, count(*) OVER () AS m FROM c) SELECT 'percent' AS kind, p * 5 AS place, n AS value, NULL AS label FROM r, (SELECT unnest(range(21))::INTEGER AS p) s WHERE k = least(m - 1, (p * 5 * m) // 100) UNION ALL SELECT 'top', t, n, label FROM (SELECT label, n, (row_number() OVER (ORDER BY n DESC, label))::INTEGER AS t FROM c) WHERE t <= 3")
def _label_sizes(spark, d):
    return labels.size_report(base(spark, d))


@query("label_shards", f"WITH {BASE}, {{CENTRES}} SELECT centre AS shard, label, count(*) AS n FROM nr JOIN (SELECT id, unnest(labels) AS label FROM b) USING (id) WHERE rank <= 2 GROUP BY ALL")
def _label_shards(spark, d):
    """Labels of the points of each shard."""
    owner = clusters.nearest(base(spark, d), centres(spark, d), 2).select("id", F.col("centre").alias("shard"))
    return labels.of_shards(base(spark, d), owner).groupBy("shard", "label").agg(F.count(F.lit(1)).alias("n"))


@query("label_inverted", f"WITH {BASE}, e AS (SELECT DISTINCT id, unnest(labels) AS label FROM b) SELECT label, id FROM e WHERE label <> '100' UNION SELECT l.label, w.id FROM (SELECT id FROM e WHERE label = '100') w, (SELECT DISTINCT label FROM e WHERE label <> '100') l")
def _inverted(spark, d):
    return labels.inverted(base(spark, d), "100")


@query("label_broken_up", f"WITH {BASE}, n AS (SELECT count(*) AS n, max(id) + 1 AS first FROM b), g AS (SELECT id, unnest([0, 1]) AS g, unnest([[labels[1]], [labels[2]]]) AS part FROM b), r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM b) SELECT CASE WHEN g = 0 THEN g.id ELSE 100000 + k END AS id, g.id AS origin, part[1] AS label FROM g JOIN r ON r.id = g.id")
def _broken(spark, d):
    return labels.broken_up(base(spark, d).select("id", "labels"), 1, 100000).select("id", "origin", F.col("labels")[0].alias("label"))


@query("label_parsed", "SELECT doc_id AS id, list_filter(list_transform(string_split(concat_ws(',', lang, ' ' || source, ''), ','), lambda x: trim(x)), lambda x: x <> '')[1] AS first, 2 AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _parsed(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang is not null and source is not null")
    lines = docs.select(F.col("doc_id").alias("id"), F.concat_ws(",", "lang", F.concat(F.lit(" "), "source"), F.lit("")).alias("line"))
    return labels.parse(lines).select("id", F.col("labels")[0].alias("first"), F.size("labels").alias("n"))


# ---- aggregates ----


@query("mean_vector", f"WITH {BASE}, e AS (SELECT unnest(range(64)) AS dim, unnest(vec) AS x FROM b) SELECT dim, round(avg(x), 6) AS mean FROM e GROUP BY dim")
def _mean(spark, d):
    return rounded(clusters.mean(base(spark, d)).withColumn("dim", F.col("dim").cast("long")), "mean")


_MEAN = "m AS (SELECT list(x ORDER BY dim) AS c FROM (SELECT dim, avg(x) AS x FROM (SELECT unnest(range(64)) AS dim, unnest(vec) AS x FROM b) GROUP BY dim))"


@query("medoid", f"WITH {BASE}, {_MEAN}, d AS (SELECT id, {sql_l2('vec', 'c')} AS dist FROM b, m) SELECT id, round(dist, 6) AS dist FROM d ORDER BY round(dist, 9), id LIMIT 1")
def _medoid(spark, d):
    return rounded(clusters.medoid(base(spark, d)), "dist")


@query("norm_percentiles", f"WITH {BASE}, r AS (SELECT {_norm} AS norm, row_number() OVER (ORDER BY {_norm}, id) - 1 AS k, count(*) OVER () AS n FROM b) SELECT p * 5 AS percent, round(norm, 6) AS norm FROM r, (SELECT unnest(range(21))::INTEGER AS p) s WHERE k = least(n - 1, (p * n) // 20)")
def _percentiles(spark, d):
    return rounded(clusters.norm_percentiles(base(spark, d)), "norm")


def centres(spark, d) -> DataFrame:
    """The first 16 vectors stand for trained centres."""
    return base(spark, d).where("id < 16").select(F.col("id").alias("centre"), "vec")


CENTRES = f"c AS (SELECT id AS centre, vec AS cvec FROM b WHERE id < 16), nd AS (SELECT id, centre, {sql_l2('vec', 'cvec')} AS dist FROM b, c), nr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, centre) AS rank FROM nd)"


@query("nearest_centres", f"WITH {BASE}, {CENTRES} SELECT id, rank::INTEGER AS rank, centre, round(dist, 6) AS dist FROM nr WHERE rank <= 2")
def _nearest(spark, d):
    return rounded(clusters.nearest(base(spark, d), centres(spark, d), 2), "dist")


_sql["label_shards"] = _sql["label_shards"].replace("{CENTRES}", CENTRES)


@query("vec_residual", f"WITH {BASE}, {CENTRES}, t AS (SELECT nr.id, nr.centre, list_transform(list_zip(vec, cvec), lambda p: p[1] - p[2]) AS a FROM nr JOIN b USING (id) JOIN c USING (centre) WHERE rank = 1) SELECT id, centre, unnest(range(len(a))) AS pos, round(unnest(a), 6) AS x FROM t")
def _residuals(spark, d):
    """Every vector less its nearest centre."""
    out = quantization.residuals(base(spark, d), centres(spark, d)).select("id", "centre", F.posexplode("vec").alias("pos", "x"))
    return rounded(out.withColumn("pos", F.col("pos").cast("long")), "x")


@query("cluster_sizes", f"WITH {BASE}, {CENTRES} SELECT centre, count(*) AS n FROM nr WHERE rank <= 2 GROUP BY centre")
def _sizes(spark, d):
    return clusters.cluster_sizes(base(spark, d), centres(spark, d), 2)


@query("lloyd_step", f"WITH {BASE}, {CENTRES}, e AS (SELECT centre, unnest(range(64)) AS dim, unnest(vec) AS x FROM nr JOIN b USING (id) WHERE rank = 1) SELECT centre, dim, round(avg(x), 6) AS mean, count(*) AS n FROM e GROUP BY ALL")
def _lloyd(spark, d):
    return rounded(clusters.lloyd_step(base(spark, d), centres(spark, d)).withColumn("dim", F.col("dim").cast("long")), "mean")


@query("kmeans_rounds", f"""WITH {BASE}, {CENTRES}, s1 AS (SELECT centre, list(x ORDER BY dim) AS cvec FROM (SELECT centre, dim, avg(x) AS x FROM (SELECT centre, unnest(range(64)) AS dim, unnest(vec) AS x FROM nr JOIN b USING (id) WHERE rank = 1) GROUP BY ALL) GROUP BY centre),
n2 AS (SELECT id, centre, row_number() OVER (PARTITION BY id ORDER BY {sql_l2('vec', 'cvec')}, centre) AS rank FROM b, s1) SELECT centre, dim, round(avg(x), 6) AS x FROM (SELECT centre, unnest(range(64)) AS dim, unnest(vec) AS x FROM n2 JOIN b USING (id) WHERE rank = 1) GROUP BY ALL""")
def _rounds(spark, d):
    """Two of Lloyd's rounds over all points."""
    out = clusters.kmeans_whole(base(spark, d), centres(spark, d), 2).select("centre", F.posexplode("vec").alias("dim", "x"))
    return rounded(out.withColumn("dim", F.col("dim").cast("long")), "x")


@query("kmeans_residual", f"WITH {BASE}, {CENTRES} SELECT round(sum(dist), 4) AS residual FROM nr WHERE rank = 1")
def _residual(spark, d):
    return clusters.residual(base(spark, d), centres(spark, d)).select(F.round("residual", 4).alias("residual"))


# ---- quantisation, with the first 16 vectors cut into 16 chunks of 4 as codebook ----

CHUNKS, WIDTH = 16, 4


def book(spark, d) -> quantization.Codebook:
    import numpy as np

    c = np.array([r[0] for r in centres(spark, d).orderBy("centre").select("vec").collect()])
    return quantization.Codebook(planner.chunk_offsets(64, CHUNKS), [c[:, m * WIDTH : (m + 1) * WIDTH] for m in range(CHUNKS)], np.zeros(64))


_part = lambda a, m: f"{a}[{m} * {WIDTH} + 1 : {m} * {WIDTH} + {WIDTH}]"
BOOK = f"ch AS (SELECT unnest(range({CHUNKS})) AS chunk), cb AS (SELECT chunk, id AS code, {_part('vec', 'chunk')} AS cen FROM b, ch WHERE id < 16)"
CODES = f"""{BOOK}, cd AS (SELECT b.id, cb.chunk, cb.code, {sql_l2(_part('b.vec', 'cb.chunk'), 'cen')} AS dist FROM b, cb),
codes AS (SELECT id, chunk, code FROM (SELECT *, row_number() OVER (PARTITION BY id, chunk ORDER BY dist, code) AS r FROM cd) WHERE r = 1)"""


@query("pq_codes", f"WITH {BASE}, {CODES} SELECT id, chunk, code FROM codes")
def _pq_codes(spark, d):
    return quantization.encode(base(spark, d), book(spark, d)).select("id", F.posexplode("codes").alias("chunk", "code")).select("id", F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"))


@query("pq_decoded", f"WITH {BASE}, {CODES}, p AS (SELECT id, chunk, unnest(cen) AS x, unnest(range({WIDTH})) AS i FROM codes JOIN cb USING (chunk, code)) SELECT id, chunk * {WIDTH} + i AS pos, round(x, 6) AS x FROM p")
def _pq_decoded(spark, d):
    b = book(spark, d)
    return rounded(quantization.decode(quantization.encode(base(spark, d), b), b).select("id", F.posexplode("vec").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x")


PQ_DIST = f"""{QUERIES}, tab AS (SELECT qid, chunk, code, {sql_l2(_part('qvec', 'chunk'), 'cen')} AS t FROM q, cb), ad AS (SELECT qid, id, sum(t) AS dist FROM codes JOIN tab USING (chunk, code) GROUP BY qid, id)"""


@query("pq_knn", f"WITH {BASE}, {CODES}, {PQ_DIST}, r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS rank, id, dist FROM ad) SELECT qid, rank::INTEGER AS rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {K}")
def _pq_knn(spark, d):
    b = book(spark, d)
    near = quantization.knn_pq(quantization.encode(base(spark, d), b), stated(spark, d), b, 2 * K).select("qid", "id", F.round("dist", 9).alias("dist"))
    return rounded(knn.ranked(near, K), "dist")


def _table_join(spark, d, metric):
    b = book(spark, d)
    q = stated(spark, d).select(F.col("id").alias("qid"), "vec")
    pairs = knn.knn(base(spark, d), stated(spark, d), 100).select("qid", "id").join(q, "qid")
    return rounded(quantization.adc_pairs(quantization.encode(base(spark, d), b), pairs, quantization.codebook_frame(spark, b), WIDTH, metric), "dist")


_PAIRS = f"pr AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {sql_l2('qvec', 'vec')}, id) AS rank FROM q, b) WHERE rank <= 100)"


@query("pq_table_join", f"WITH {BASE}, {CODES}, {PQ_DIST}, {_PAIRS} SELECT qid, id, round(dist, 6) AS dist FROM ad JOIN pr USING (qid, id)")
def _pq_join(spark, d):
    """Asymmetric distances of the 100 nearest points of each query by joins with the codebook table."""
    return _table_join(spark, d, "l2")


@query("pq_table_join_ip", f"WITH {BASE}, {CODES}, {QUERIES}, {_PAIRS}, t AS (SELECT qid, id, sum(-{sql_dot(_part('qvec', 'chunk'), 'cen')}) AS dist FROM codes JOIN cb USING (chunk, code) JOIN pr USING (id) JOIN q USING (qid) GROUP BY qid, id) SELECT qid, id, round(dist, 6) AS dist FROM t")
def _pq_join_ip(spark, d):
    return _table_join(spark, d, "ip")


@query("pq_knn_ip", f"WITH {BASE}, {CODES}, {PQ_DIST.replace(sql_l2(_part('qvec', 'chunk'), 'cen'), '-' + sql_dot(_part('qvec', 'chunk'), 'cen'))}, r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS rank, id, dist FROM ad) SELECT qid, rank::INTEGER AS rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {K}")
def _pq_knn_ip(spark, d):
    """The best by tables of negative inner products."""
    b = book(spark, d)
    near = quantization.knn_pq(quantization.encode(base(spark, d), b), stated(spark, d), b, 4 * K, "ip").select("qid", "id", F.round("dist", 9).alias("dist"))
    return rounded(knn.ranked(near, K), "dist")


@query("pq_reranked", f"""WITH {BASE}, {CODES}, {PQ_DIST}, r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS rank, id FROM ad),
s AS (SELECT qid, r.id, {sql_l2('qvec', 'vec')} AS dist FROM r JOIN b USING (id) JOIN q USING (qid) WHERE rank <= 100), f AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, id, dist FROM s)
SELECT qid, rank::INTEGER AS rank, id, round(dist, 6) AS dist FROM f WHERE rank <= {K}""")
def _reranked(spark, d):
    b = book(spark, d)
    return rounded(quantization.knn_reranked(base(spark, d), quantization.encode(base(spark, d), b), stated(spark, d), b, K, 100), "dist")


@query("pq_reordered", f"WITH {BASE}, {CODES} SELECT (id * 7919) % 1000003 AS new_id, chunk, code FROM codes")
def _reordered(spark, d):
    """Codes under new ids, by a join with the id map."""
    mapping = base(spark, d).select(F.col("id").alias("old"), (F.col("id") * 7919 % 1000003).alias("new"))
    codes = quantization.reordered(quantization.encode(base(spark, d), book(spark, d)), mapping)
    return codes.select("id", F.posexplode("codes").alias("chunk", "code")).select(F.col("id").alias("new_id"), F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"))


@query("pq_trained")
def _trained(spark, d):
    """A trained codebook's error, plain and rotated."""
    points = base(spark, d)
    x = clusters.sample_matrix(points)
    books = (("plain", quantization.train(x, 8, 32)), ("rotated", quantization.train_rotated(x, 8, 32, rounds=4)))
    return spark.createDataFrame([(name, quantization.error(points, b)) for name, b in books], "kind string, error double")


@query("vec_rotated", f"WITH {BASE}, t AS (SELECT id, list_transform(list_zip(list_reverse(vec), range(64)), lambda p: (CASE WHEN p[2] % 2 = 0 THEN 1 ELSE -1 END) * (p[1] - 0.25)) AS a FROM b) SELECT id, unnest(range(len(a))) AS pos, round(unnest(a), 6) AS x FROM t")
def _rotated(spark, d):
    """Vectors less a mean, rotated by an orthogonal matrix (here one that turns them round, with every second sign changed)."""
    import numpy as np

    turn = np.fliplr(np.eye(64)) * np.where(np.arange(64) % 2 == 0, 1.0, -1.0)[None, :]
    b = quantization.Codebook(planner.chunk_offsets(64, 1), [np.zeros((1, 64))], np.full(64, 0.25), turn)
    return rounded(quantization.prepared(base(spark, d), b).select("id", F.posexplode("vec").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x")


# ---- hashes, with the first vectors as planes ----


def planes(spark, d, bits: int = BITS) -> list[list[float]]:
    return [list(r[0]) for r in base(spark, d).where(F.col("id") < bits).orderBy("id").select("vec").collect()]


def sql_hashes(bits: int) -> str:
    return f"pl AS (SELECT id AS i, vec AS plane FROM b WHERE id < {bits}), h AS (SELECT b.id, sum(CASE WHEN {sql_dot('vec', 'plane')} >= 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS hash FROM b, pl GROUP BY b.id)"


@query("lsh_hashes", f"WITH {BASE}, {sql_hashes(32)} SELECT id, hash FROM h")
def _hashes(spark, d):
    return hashing.hashes(base(spark, d), planes(spark, d, 32))


_CAPPED = f"hb AS (SELECT hash, id FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM h) WHERE r <= {hashing.BUCKET_CAP})"


@query("lsh_buckets", f"WITH {BASE}, {sql_hashes(BITS)}, {_CAPPED} SELECT hash, id FROM hb")
def _buckets(spark, d):
    return hashing.buckets(hashing.hashes(base(spark, d), planes(spark, d)))


@query("lsh_hamming_ball", f"WITH {BASE}, {sql_hashes(BITS)}, s AS (SELECT unnest(range({1 << BITS})) AS x) SELECT id AS qid, x AS hash FROM h, s WHERE id % {QUERY_STEP} = 0 AND bit_count(xor(hash, x)) <= 2")
def _ball(spark, d):
    h = hashing.hashes(stated(spark, d), planes(spark, d)).withColumnRenamed("id", "qid")
    return hashing.probes(h, BITS, 2)


@query("lsh_probe", f"WITH {BASE}, {sql_hashes(BITS)} SELECT a.id AS qid, b.id FROM h a, h b WHERE a.id % {QUERY_STEP} = 0 AND bit_count(xor(a.hash, b.hash)) <= 1")
def _probe(spark, d):
    """All ids within one flip: the probed table has no cap."""
    h = hashing.hashes(base(spark, d), planes(spark, d))
    return hashing.probe(h, h.where(F.col("id") % QUERY_STEP == 0).withColumnRenamed("id", "qid"), BITS, 1)


@query("lsh_entry_points", f"WITH {BASE}, {sql_hashes(BITS)}, {_CAPPED}, e AS (SELECT a.id AS qid, b.id, row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.hash, b.hash)), b.id) AS r FROM h a, hb b WHERE a.id % {QUERY_STEP} = 0 AND bit_count(xor(a.hash, b.hash)) <= 1) SELECT qid, id FROM e WHERE r <= {hashing.ENTRY_CAP}")
def _entries(spark, d):
    h = hashing.hashes(base(spark, d), planes(spark, d))
    return hashing.entry_points(hashing.buckets(h), h.where(F.col("id") % QUERY_STEP == 0).withColumnRenamed("id", "qid"), BITS, 1, 0)


@query("lsh_sampled_buckets", f"""WITH RECURSIVE {BASE}, {sql_hashes(BITS)}, {_CAPPED}, s AS (SELECT hash, count(*) AS n FROM hb GROUP BY hash), t AS (SELECT sum(n) // 2 AS target FROM s),
v AS (SELECT unnest(range({hashing.BUCKET_CAP + 1})) AS level), w AS (SELECT level, sum(least(n, greatest(level, least(4, n)))) AS total FROM v, s GROUP BY level),
l AS (SELECT coalesce(min(level), (SELECT max(n) FROM s)) AS level FROM w, t WHERE total >= target) SELECT hash, least(n, greatest(level, 4)) AS kept FROM s, l""")
def _sampled(spark, d):
    """Ids kept of each bucket; which ones is the choice of a seeded hash."""
    h = hashing.buckets(hashing.hashes(base(spark, d), planes(spark, d)))
    return hashing.sampled_buckets(h, h.count() // 2).groupBy("hash").agg(F.count(F.lit(1)).alias("kept"))


# ---- graphs, over the exact 5-nearest-neighbour graph ----

EDGES = f"""ed AS (SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY {sql_l2('a.vec', 'b.vec')}, b.id) AS pos FROM b a, b b WHERE a.id <> b.id) WHERE pos <= 5)"""


def edges(spark, d) -> DataFrame:
    """(src, pos, dst) of the exact graph, written once a query."""
    from ..session import persisted

    return persisted(graphs.knn_graph(base(spark, d), 5).select("src", "pos", "dst"))


def lists(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("nbrs"))


@query("graph_degrees", f"WITH {BASE}, {EDGES}, r AS (SELECT dst AS src, count(*) AS n FROM ed GROUP BY dst) SELECT count(*) AS nodes, max(n) AS largest, min(n) AS smallest, round(avg(n), 6) AS average, sum(CASE WHEN n < 2 THEN 1 ELSE 0 END)::BIGINT AS under_two FROM r")
def _degrees(spark, d):
    out = graphs.degrees(graphs.reversed_edges(edges(spark, d)))
    return rounded(out.withColumn("largest", F.col("largest").cast("long")).withColumn("smallest", F.col("smallest").cast("long")), "average")


@query("graph_bfs_levels", f"WITH RECURSIVE {BASE}, {EDGES}, w(node, level) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, level + 1 FROM w JOIN ed ON src = node WHERE level < 32), f AS (SELECT node, min(level) AS level FROM w GROUP BY node) SELECT level, count(*) AS n FROM f GROUP BY level")
def _bfs(spark, d):
    return graphs.bfs_levels(edges(spark, d), 0)


@query("graph_stitched", f"WITH {BASE}, {EDGES}, u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed) SELECT src, count(*) AS n, sum(dst)::BIGINT AS total FROM u GROUP BY src")
def _stitched(spark, d):
    e = edges(spark, d)
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graphs.stitched(both).select("src", F.size("nbrs").cast("long").alias("n"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("graph_expanded", f"WITH {BASE}, {EDGES}, f AS (SELECT src AS qid, dst AS node FROM ed WHERE src % {QUERY_STEP} = 0) SELECT DISTINCT qid, dst AS node FROM f JOIN ed ON src = node WHERE (qid, dst) NOT IN (SELECT qid, node FROM f) AND dst <> qid")
def _expanded(spark, d):
    e = edges(spark, d)
    frontier = e.where(F.col("src") % QUERY_STEP == 0).select(F.col("src").alias("qid"), F.col("dst").alias("node"))
    visited = frontier.unionByName(frontier.select("qid", F.col("qid").alias("node")))
    return graphs.expand(frontier, e, visited)


@query("graph_repaired", f"""WITH {BASE}, {EDGES}, g AS (SELECT id FROM b WHERE id % 10 = 3), l AS (SELECT * FROM ed WHERE src NOT IN (FROM g)),
n AS (SELECT src, dst FROM l UNION SELECT l.src, e.dst FROM l JOIN g ON l.dst = g.id JOIN ed e ON e.src = l.dst) SELECT src, count(*) AS n, sum(dst)::BIGINT AS total FROM n WHERE src <> dst AND dst NOT IN (FROM g) GROUP BY src""")
def _repaired(spark, d):
    gone = base(spark, d).where("id % 10 = 3").select("id")
    fixed = graphs.repaired(lists(edges(spark, d)), gone).where(F.size("nbrs") > 0)
    return fixed.select("src", F.size("nbrs").cast("long").alias("n"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("graph_compacted", f"""WITH {BASE}, {EDGES}, l AS (SELECT id AS old, row_number() OVER (ORDER BY id) - 1 AS src FROM b WHERE id % 10 <> 3)
SELECT s.src, s.old, count(t.src) AS n, coalesce(sum(t.src), 0)::BIGINT AS total FROM l s LEFT JOIN ed ON ed.src = s.old LEFT JOIN l t ON t.old = ed.dst GROUP BY s.src, s.old""")
def _compacted(spark, d):
    live = lists(edges(spark, d)).where("src % 10 <> 3")
    return graphs.compacted(live).select("src", "old", F.size("nbrs").cast("long").alias("n"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("graph_free_slots", f"WITH {BASE} SELECT range AS slot FROM range(20000) WHERE range NOT IN (SELECT id FROM b WHERE id % 10 <> 3)")
def _free(spark, d):
    """Places that deleted points leave, and those behind the last one."""
    return graphs.free_slots(base(spark, d).where("id % 10 <> 3").select("id"), 20000)


@query("graph_label_starts", f"""WITH {BASE}, e AS (SELECT id, vec, unnest(list_distinct(labels)) AS label FROM b), m AS (SELECT label, list(x ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS dim, unnest(vec) AS x FROM e) GROUP BY ALL) GROUP BY label)
SELECT label, id FROM (SELECT e.label, id, row_number() OVER (PARTITION BY e.label ORDER BY round({sql_l2('vec', 'c')}, 9), id) AS r FROM e JOIN m ON m.label = e.label) WHERE r = 1""")
def _starts(spark, d):
    """The point of each label that is nearest to its points' mean."""
    return graphs.stitched_starts(base(spark, d))


@query("graph_merged_shards", f"WITH {BASE}, {EDGES}, u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed) SELECT src, count(*) AS n, sum(dst)::BIGINT AS total FROM u GROUP BY src")
def _merged(spark, d):
    """The union of a node's lists in two overlapping shards, under a degree that cuts none."""
    e = edges(spark, d)
    both = graphs.merged_shards(lists(e).unionByName(graphs.reversed_edges(e)), 1 << 20)
    return both.select("src", F.size("nbrs").cast("long").alias("n"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("graph_merged_cut", f"WITH {BASE}, {EDGES}, u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed) SELECT src, least(count(*), 6) AS n FROM u GROUP BY src")
def _merged_cut(spark, d):
    """Degrees of the united lists, at most 6; which neighbours stay is the order of a seeded hash."""
    e = edges(spark, d)
    return graphs.merged_shards(lists(e).unionByName(graphs.reversed_edges(e)), 6).select("src", F.size("nbrs").cast("long").alias("n"))


@query("graph_pruned", f"""WITH RECURSIVE {BASE}, {EDGES}, p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS k, dist FROM (SELECT ed.src, ed.dst, {sql_l2('x.vec', 'y.vec')} AS dist FROM ed JOIN b x ON x.id = ed.src JOIN b y ON y.id = ed.dst)),
z AS (SELECT a.src, a.k AS taken, c.k AS later, c.dist / nullif({sql_l2('x.vec', 'y.vec')}, 0) AS factor FROM p a JOIN p c ON a.src = c.src AND a.k < c.k JOIN b x ON x.id = a.dst JOIN b y ON y.id = c.dst),
w(src, k, kept) AS (SELECT src, 1::BIGINT, [1::BIGINT] FROM p WHERE k = 1 UNION ALL SELECT w.src, w.k + 1, CASE WHEN len(w.kept) < 3 AND NOT EXISTS (SELECT 1 FROM z WHERE z.src = w.src AND z.later = w.k + 1 AND list_contains(w.kept, z.taken) AND coalesce(z.factor, 'inf'::DOUBLE) > 1) THEN list_append(w.kept, w.k + 1) ELSE w.kept END FROM w JOIN p ON p.src = w.src AND p.k = w.k + 1),
f AS (SELECT src, max_by(kept, k) AS kept FROM w GROUP BY src) SELECT f.src, count(*) AS n, sum(p.dst)::BIGINT AS total FROM f JOIN p ON p.src = f.src AND list_contains(f.kept, p.k) GROUP BY f.src""")
def _pruned(spark, d):
    """The exact lists of five pruned to three at the factor 1."""
    out = graphs.pruned(lists(edges(spark, d)), base(spark, d), 3, 1.0)
    return out.select("src", F.size("nbrs").cast("long").alias("n"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def sharded(spark, d) -> DataFrame:
    """Shards under a bound that a small table, too, has several of."""
    return clusters.sharded_under(base(spark, d).select("id", "vec", "labels"), 4096)


def _searched(metric: str):
    def run(spark, d):
        """Sharded build and greedy search; the recall is tested."""
        s = sharded(spark, d)
        return rounded(graphs.search(s, graphs.build(s, 16, 40, metric=metric), stated(spark, d), K, 80, metric=metric), "dist")

    return run


for _metric in ("l2", "ip", "cosine"):
    query("graph_search" if _metric == "l2" else f"graph_search_{_metric}")(_searched(_metric))


@query("graph_filtered_search")
def _graph_filtered(spark, d):
    """A filtered build, searched from the starts of the label."""
    s = sharded(spark, d)
    return rounded(graphs.search(s, graphs.build_filtered(s, 16, 40), stated(spark, d), K, 60, keep_label="101"), "dist")


def paged(spark, d) -> DataFrame:
    from ..session import persisted

    s = sharded(spark, d)
    return persisted(pages.build(s, graphs.build(s, 16, 40), 9, 60))


@query("page_search")
def _page_search(spark, d):
    """Neighbours queue by code distances; only members of pages that were read are scored."""
    return rounded(pages.search(paged(spark, d), stated(spark, d), K, 80, book=quantization.fit(base(spark, d), 16, 64)), "dist")


@query("page_search_hashed")
def _page_search_hashed(spark, d):
    """Entry nodes from hash buckets instead of the start page."""
    h = hashing.hashes(base(spark, d), hashing.random_planes(64, BITS))
    found = hashing.entry_points(hashing.buckets(h), h.where(F.col("id") % QUERY_STEP == 0).withColumnRenamed("id", "qid"), BITS, 1, 0)
    entries = {r["qid"]: list(r["ids"]) for r in found.groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("ids")).collect()}
    return rounded(pages.search(paged(spark, d), stated(spark, d), K, 80, entries=entries, book=quantization.fit(base(spark, d), 16, 64)), "dist")


@query("page_packed", f"WITH {BASE} SELECT id, 1 AS pages FROM b")
def _packed(spark, d):
    """Every vector lies in one page, at one place, with no more than nine in a page."""
    p = paged(spark, d)
    placed = pages.id_map(p, 9)
    return placed.groupBy(F.col("old").alias("id")).agg((F.count_distinct("new") * F.max(F.when(F.pmod("new", F.lit(9)) < 9, 1))).cast("int").alias("pages"))


@query("page_visits", f"""WITH {BASE}, {QUERIES}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {sql_l2('qvec', 'vec')}, id) AS rank FROM q, b),
p AS (SELECT DISTINCT qid, id // 9 AS page_id FROM r WHERE rank <= {K}) SELECT page_id, count(*) AS n FROM p GROUP BY page_id""")
def _visits(spark, d):
    """How often pages are read, from a recorded log: that of a search that reads the sequential pages of its exact results."""
    from ..session import persisted

    found = knn.knn(base(spark, d), stated(spark, d), K)
    log = found.groupBy("qid").agg(F.collect_set(F.floor(F.col("id") / 9)).alias("pages"))
    return pages.visits(persisted(log))


@query("page_cache_hits", f"""WITH {BASE}, {QUERIES}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {sql_l2('qvec', 'vec')}, id) AS rank FROM q, b),
p AS (SELECT DISTINCT qid, id // 9 AS page_id FROM r WHERE rank <= {K}), c AS (SELECT page_id FROM p GROUP BY page_id ORDER BY count(*) DESC, page_id LIMIT 10)
SELECT qid, count(*) AS reads, count(*) FILTER (WHERE page_id IN (FROM c))::BIGINT AS hits FROM p GROUP BY qid""")
def _cache_hits(spark, d):
    """Reads that a cache of the ten most read pages serves."""
    from ..session import persisted

    found = knn.knn(base(spark, d), stated(spark, d), K)
    log = persisted(found.groupBy("qid").agg(F.collect_set(F.floor(F.col("id") / 9)).alias("pages")))
    return pages.cached(log, pages.visits(log, 10))


@query("index_active", sql_knn(sql_l2("qvec", "vec"), "id % 10 <> 3"))
def _index_active(spark, d):
    """An index of fresh points, a tenth of them deleted: what is not linked yet is searched exactly."""
    from ..index import Parameters, VectorIndex

    points = base(spark, d).select("id", "vec", "labels")
    index = VectorIndex.build(points.limit(0), label_col="labels", parameters=Parameters(8, 20))
    index, _ = index.insert(points)
    index, _ = index.delete(points.where("id % 10 = 3").select("id"))
    return rounded(index.search(stated(spark, d), K, 20), "dist")


@query("index_reinserted", f"WITH {BASE}, {QUERIES} SELECT qid, qid AS id, 0.0::DOUBLE AS dist FROM q")
def _index_reinserted(spark, d):
    """Ids that are deleted and inserted again are found at their own place, beside the repaired graph."""
    from ..index import Parameters, VectorIndex

    points = base(spark, d).select("id", "vec", "labels")
    again = points.where(F.col("id") % QUERY_STEP == 0)
    index = VectorIndex.build(points, label_col="labels", parameters=Parameters(12, 30))
    index, _ = index.delete(again.select("id"))
    index, _ = index.insert(again)
    return index.search(stated(spark, d), 1, 60).select("qid", "id", "dist")


@query("graph_stitched_build", f"WITH {BASE} SELECT id AS src, 1 AS reachable FROM b")
def _stitched_build(spark, d):
    """Every point is a node of the stitched graph, with neighbours that share a label and at most 24 of them."""
    points = base(spark, d).select("id", "vec", "labels")
    edges_ = graphs.build_stitched(points, 12, 30, 24)
    pairs = edges_.select("src", F.size("nbrs").alias("n"), F.explode("nbrs").alias("dst"))
    own, theirs = points.select(F.col("id").alias("src"), F.col("labels").alias("own")), points.select(F.col("id").alias("dst"), F.col("labels").alias("theirs"))
    fits = pairs.join(own, "src").join(theirs, "dst").withColumn("fits", F.arrays_overlap("own", "theirs") & (F.col("n") <= 24))
    return fits.groupBy("src").agg(F.min(F.col("fits").cast("int")).alias("reachable"))


@query("page_sequential", f"WITH {BASE} SELECT id // 9 AS page_id, count(*) AS n, min(id) AS first, max(id) AS last FROM b GROUP BY 1")
def _sequential(spark, d):
    return pages.sequential(base(spark, d), 9)


# ---- planner, generators, slices ----


_CASES = [(128, 1, 20, 1.0, 23), (128, 1, 12, 0.0, 28), (100, 1, 18, 1.0, 25), (96, 4, 60, 1.0, 31), (64, 4, 16, 1.0, 8), (64, 4, 16, 0.5, 8), (64, 4, 16, 0.0, 8)]


@query("planner_layouts", f"""WITH c(dim, bytes, pq, share, least) AS (VALUES {', '.join(f"({a}, {b}, {c}, {e}::DOUBLE, {f})" for a, b, c, e, f in _CASES)}),
f AS (SELECT c.*, d, greatest(0, 4096 - (4 + 4 * d + pq * (d - floor(d * share)::INTEGER))) // (dim * bytes) AS fit FROM c, (SELECT unnest(range(1, 4097))::INTEGER AS d) r),
g AS (SELECT dim, bytes, pq, share, least, min(d) AS degree FROM f WHERE d >= least AND (fit = 0 OR d >= least * fit) GROUP BY ALL),
h AS (SELECT g.*, f.fit AS per_page FROM g JOIN f USING (dim, bytes, pq, share, least) WHERE f.d = g.degree),
i AS (SELECT h.dim, h.bytes, h.pq, h.share, h.least, per_page, min(f.d) - 1 AS page_degree FROM h JOIN f USING (dim, bytes, pq, share, least) WHERE f.d > h.degree AND f.fit <> per_page GROUP BY ALL)
SELECT dim, bytes, pq, share, least, page_degree, per_page, page_degree // per_page + CASE WHEN (page_degree % per_page)::DOUBLE / per_page >= 0.9 THEN 1 ELSE 0 END AS degree FROM i""")
def _planner(spark, d):
    rows = [(*c, *planner.page_layout(*c), planner.recommended_degree(*c)) for c in _CASES]
    return spark.createDataFrame(rows, "dim int, bytes int, pq int, share double, least int, page_degree int, per_page int, degree int")


@query("random_slice", "SELECT vec_id AS id FROM embeddings WHERE ((vec_id + 1) * 2654435761) % 4294967296 < 0.25 * 4294967296")
def _slice(spark, d):
    return generators.bernoulli(base(spark, d).select("id"), 0.25)


@query("random_vectors", "SELECT range AS id, 16 AS dims, 3.0::DOUBLE AS norm FROM range(200)")
def _vectors(spark, d):
    """Generated vectors have the dimensions and the norm asked for."""
    out = generators.vectors(spark, 200, 16, 3.0)
    return rounded(out.select("id", F.size("vec").alias("dims"), v.norm(F.col("vec")).alias("norm")), "norm")


@query("generated_labels", "SELECT range AS id, (range % 12 + 1)::VARCHAR AS label FROM range(200)")
def _one_label(spark, d):
    return generators.one_label(spark, 200, 12).select("id", F.col("labels")[0].alias("label"))


@query("random_labels", "SELECT range AS id, true AS valid FROM range(200)")
def _labels(spark, d):
    """Labels drawn by Zipf's law: 1 to 12, each once in rising order, the first always; \"0\" where none is drawn."""
    own = F.transform("labels", lambda x: x.cast("int"))
    valid = (F.array_sort(F.array_distinct(own)) == own) & F.forall(own, lambda x: (x >= 0) & (x <= 12)) & (own[0] == 1)
    return generators.zipf_labels(spark, 200, 12).select("id", valid.alias("valid"))


@query("sampled_query_labels", f"WITH {BASE} SELECT range AS qid, true AS known FROM range(100)")
def _query_labels(spark, d):
    """Labels drawn from the points' own, one a query."""
    known = labels.counts(base(spark, d)).select("label", F.lit(True).alias("known"))
    return generators.sampled_query_labels(base(spark, d), 100).join(known, "label", "left").select("qid", F.coalesce("known", F.lit(False)).alias("known"))


@query("simulated_shard_recall", "SELECT 90 AS recall")
def _simulated(spark, d):
    """The recall of merged shards that find nine of ten of their own, in whole per cent."""
    from ..operators.evaluate import simulated_recall

    return simulated_recall(spark, 8, 10, 0.9, 100_000).select(F.round(100 * F.col("recall")).cast("int").alias("recall"))


# ---- files: written to the shared folder and read back ----


def _stored(spark, table: DataFrame, layout: str, kind: str, parts: int = 3) -> DataFrame:
    import uuid

    from ..session import shared_dir
    from ..sources import files

    path = f"{shared_dir(spark)}/quiverlake/files-{uuid.uuid4().hex}"
    files.write(table, path, layout, kind, parts)
    return files.read(spark, path, layout, kind)


def _values(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 4).alias("x"))


_NUMBERED = "n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, vec FROM b)"
for _layout in ("bin", "vecs"):
    query(f"files_{_layout}_float", f"WITH {BASE}, {_NUMBERED}, t AS (SELECT id, list_transform(vec, lambda x: x::FLOAT::DOUBLE) AS a FROM n) SELECT id, unnest(range(len(a))) AS pos, round(unnest(a), 4) AS x FROM t")(
        lambda spark, d, layout=_layout: _values(_stored(spark, base(spark, d), layout, "float"))
    )


@query("files_cast_uint8", f"WITH {BASE}, {_NUMBERED}, t AS (SELECT id, list_transform(vec, lambda x: (trunc(abs(x * 1000))::BIGINT % 256)::DOUBLE) AS a FROM n) SELECT id, unnest(range(len(a))) AS pos, unnest(a) AS x FROM t")
def _cast(spark, d):
    """Floats cast to bytes on the way to a file of bytes."""
    bytes_ = base(spark, d).withColumn("vec", v.to_uint8(F.transform("vec", lambda x: F.abs(x * 1000))))
    return _values(_stored(spark, bytes_, "vecs", "uint8"))


@query("files_tsv", f"WITH {BASE}, {_NUMBERED}, t AS (SELECT id, list_transform(vec, lambda x: x::FLOAT::DOUBLE) AS a FROM n) SELECT id, unnest(range(len(a))) AS pos, round(unnest(a), 4) AS x FROM t")
def _tsv(spark, d):
    import uuid

    from ..session import shared_dir
    from ..sources import files

    path = f"{shared_dir(spark)}/quiverlake/files-{uuid.uuid4().hex}"
    files.write_tsv(base(spark, d).select("id", F.transform("vec", lambda x: x.cast("float")).alias("vec")), path)
    return _values(files.read_tsv(spark, path))


@query("files_graph", f"WITH {BASE}, {EDGES} SELECT src, count(*) AS n, sum(dst)::BIGINT AS total FROM ed GROUP BY src")
def _graph_file(spark, d):
    """The exact graph through a graph file."""
    import uuid

    from ..session import shared_dir
    from ..sources import files

    path = f"{shared_dir(spark)}/quiverlake/files-{uuid.uuid4().hex}"
    files.write_graph(lists(edges(spark, d)), path, 0)
    return files.read_graph(spark, path).select("src", F.size("nbrs").cast("long").alias("n"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("files_truth", sql_knn(sql_l2("qvec", "vec")).replace("SELECT qid, rank::INTEGER", "SELECT (qid / 50)::BIGINT AS qid, rank::INTEGER").replace("round(dist, 6)", "round(dist::FLOAT::DOUBLE, 2)"))
def _truth(spark, d):
    """Exact neighbours through a truth file, queries numbered in order."""
    import uuid

    from ..session import shared_dir
    from ..sources import files

    path = f"{shared_dir(spark)}/quiverlake/files-{uuid.uuid4().hex}"
    files.write_truth(knn.knn(base(spark, d), stated(spark, d), K), path)
    return files.read_truth(spark, path).withColumn("dist", F.round(F.col("dist").cast("double"), 2))


@query("shard_vectors", f"WITH {BASE}, {CENTRES} SELECT id, centre AS shard FROM nr WHERE rank <= 2 AND centre < 4")
def _shards(spark, d):
    """Vectors of some shards, by a semi join."""
    owner = clusters.nearest(base(spark, d), centres(spark, d), 2).where("centre < 4").select("id", F.col("centre").alias("shard"))
    return owner.join(base(spark, d).select("id"), "id", "left_semi")


@query("latency_percentiles", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT p AS percent, round(value, 6) AS value FROM r, (SELECT unnest([50, 90, 95, 99])::INTEGER AS p) s WHERE k = (p * n) // 100")
def _latency(spark, d):
    """Order statistics at index floor(p * n), ranked per range partition."""
    from ..operators.evaluate import percentiles

    return rounded(percentiles(spark.read.parquet(f"{d}/events.parquet").where("value is not null"), "value", "event_id", [50, 90, 95, 99]), "value")


del Window

"""Vector expressions over ARRAY columns, inside the JVM: distances, norms, augmentation, quantisation, hashes, label predicates.

All sums run left to right in double precision. L2 distances are squared, inner-product distances negative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine", "fast_l2")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; NaN where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot(a, b) / n)


def fast_l2(point: Column, query: Column, squared_norm: Column) -> Column:
    """Ranks like L2 for one query, but lacks the query's own norm."""
    return squared_norm - 2 * dot(point, query)


def distance(metric: str, a: Column, b: Column, integers: bool = False) -> Column:
    """The distance of a metric. Integer vectors have L2 and cosine only."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}: one of {', '.join(METRICS)}")
    if integers and metric in ("ip", "fast_l2"):
        raise ValueError("integer vectors have l2 and cosine distances only")
    return {"l2": l2, "ip": inner_product, "cosine": cosine, "fast_l2": lambda x, y: fast_l2(x, y, dot(x, x))}[metric](a, b)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x / by)


def normalized(v: Column, eps: float = 1.1920929e-07) -> Column:
    """Divided by sqrt(eps + squared norm), so that a zero vector stays zero."""
    return scaled(v, F.sqrt(F.lit(eps) + dot(v, v)))


def normalized_raw(v: Column) -> Column:
    """Divided by the norm; null where the norm is zero."""
    n = norm(v)
    return F.when(n > 0, scaled(v, n))


def mips_augmented(v: Column, max_norm: Column) -> Column:
    """v / M with a last dimension sqrt(max(0, 1 - |v|^2 / M^2)): L2 on the result ranks like the inner product."""
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - dot(v, v) / (max_norm * max_norm)))
    return F.concat(scaled(v, max_norm), F.array(rest))


def mips_query(v: Column) -> Column:
    return F.concat(normalized_raw(v), F.array(F.lit(0.0)))


def to_int8(v: Column, bias: float, scale: float) -> Column:
    """(x - bias) * 254 / scale, truncated towards zero and clipped to -128..127."""
    return F.transform(doubles(v), lambda x: F.least(F.greatest((x - bias) * 254.0 / scale, F.lit(-128.0)), F.lit(127.0)).cast("int"))


def from_int8(v: Column, bias: float, scale: float) -> Column:
    return F.transform(doubles(v), lambda x: (x - bias) * scale)


def to_uint8(v: Column) -> Column:
    return F.transform(v, lambda x: F.pmod(x.cast("long"), F.lit(256)).cast("int"))


def plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y if sign > 0 else x - y)


def sign_hash(v: Column, planes: Column, eps: float = 1e-8) -> Column:
    """Bit i is set if the product with plane i is at least 0; a vector of norm eps or less is treated as zero. ``planes``: array of arrays."""
    n = norm(v)
    unit = F.when(n > eps, scaled(v, n)).otherwise(F.transform(doubles(v), lambda x: F.lit(0.0)))
    # bound once, or each plane would normalise the vector again
    return F.get(
        F.transform(
            F.array(unit),
            lambda u: F.aggregate(
                F.transform(planes, lambda p, i: F.when(dot(u, p) >= 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        ),
        F.lit(0),
    )


def hamming_ball(h: Column, bits: int, radius: int) -> Column:
    """All hashes within ``radius`` bit flips, each once."""
    ball = F.array(h)
    for _ in range(radius):
        flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.pow(F.lit(2.0), i).cast("long"))
        ball = F.array_distinct(F.concat(ball, F.flatten(F.transform(ball, lambda x: F.transform(flips, lambda b: x.bitwiseXOR(b))))))
    return ball


def page_of(node: Column, per_page: int) -> Column:
    return F.floor(node / per_page)


def slot_of(node: Column, per_page: int) -> Column:
    return F.pmod(node, F.lit(per_page))


def label_matches(labels: Column, wanted: Column, universal: Column | None = None) -> Column:
    """Whether label arrays meet, or the point carries the universal label."""
    meets = F.arrays_overlap(labels, wanted)
    return meets if universal is None else meets | F.array_contains(labels, universal)


def register(spark) -> None:
    """SQL functions vec_l2, vec_ip, vec_cosine, vec_norm over ARRAY<DOUBLE>, as SQL-language functions that Catalyst inlines."""
    one = "aggregate({}, 0D, (s, x) -> s + x)"
    product = one.format("zip_with(a, b, (x, y) -> x * y)")
    bodies = {
        "vec_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": one.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))"),
        "vec_ip(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": "-" + product,
        "vec_norm(a ARRAY<DOUBLE>)": "sqrt(" + one.format("transform(a, x -> x * x)") + ")",
        "vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": f"1D - {product} / (sqrt({one.format('transform(a, x -> x * x)')}) * sqrt({one.format('transform(b, x -> x * x)')}))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")

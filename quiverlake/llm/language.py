"""Operator 9, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training text; the weights from a bounded sample of them, by follow-the-regularised-leader with
elastic-net penalties; a temperature fitted on the sample's last fifth calibrates the probabilities.

Nulls: a null text, or one without a letter, is ``und`` with score 0. A null language is no label; without labels all texts are ``und``.
Rows without doc_id are training rows like any other and get a prediction each; repeated rows stay, and are learned from once. What the
driver collects is bounded by LANGUAGE_BOUND times the number of languages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 15
ORDERS = (1, 2, 3)
#: Bound on the documents of each language in the sample; FTRL's rate, stabiliser, L1 and L2 penalties and passes.
LANGUAGE_BOUND = 800
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.005, 3
UNKNOWN = "und"

OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, ASCII other than letters as blanks, and the offsets of the texts."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    ends = np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(low)], pa.int32()), low.cast(pa.string())), "")[0].as_py()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points < 128) & ((points < 97) | (points > 122))] = 32
    return points, np.concatenate(([0], ends))


def counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the n-grams of one text."""
    keys = []
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, np.uint32)
        for i in range(order):
            h = (h ^ points[i : n + i]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
        keys.append((h * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint32)
    if len(every) < 1 << (BITS - 3):
        used, n = np.unique(every, return_counts=True)
        return used.astype(np.int64), n
    total = np.bincount(every, minlength=1 << BITS)
    used = np.flatnonzero(total)
    return used, total[used]


def vector(points: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of one text: sublinear TF by IDF, of unit length."""
    used, n = counts(points)
    x = np.log1p(n) * idf[used]
    return used, x / max(float(np.sqrt((x * x).sum())), 1e-12)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in common.blocks(batches):
        points, at = code_points(batch.column("text"))
        for i in range(batch.num_rows):
            yield batch, i, points[at[i] : at[i + 1]]


def document_frequency(training: DataFrame) -> tuple[np.ndarray, int]:
    """Over all training texts: how many hold each bucket (summed by bucket, at most 2**BITS rows to the driver), and how many there are."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for _, _, points in texts_of(batches):
            total[counts(points)[0]] += 1
            total[-1] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros((1 << BITS) + 1, np.float64)
    for bucket, n in training.select("text").mapInArrow(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out[:-1], int(out[-1])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (2**BITS + 1, classes); the last row is the bias."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(9)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, 1 << BITS), np.append(x, 0.3)
            w = weights(at)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def logits(at: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[at] + 0.3 * w[-1]


def temperature(rows: list[tuple[np.ndarray, np.ndarray, int]], w: np.ndarray) -> float:
    """The temperature of least negative log-likelihood among 0.05 to 20."""
    if not rows:
        return 1.0
    z, y = np.array([logits(a, x, w) for a, x, _ in rows]), np.array([r[2] for r in rows])

    def loss(t: float) -> float:
        s = z / t
        top = s.max(axis=1)
        return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.05, 20, 120), key=loss))


def fit(training: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, idf, weights, temperature) from training(doc_id, text, lang)."""
    known = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    df, n = document_frequency(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, LANGUAGE_BOUND / sizes[k]) * (1 << 20))))]) if languages else None
    if not languages:
        return [], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0
    code = {k: i for i, k in enumerate(languages)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, points in texts_of(batches):
            at, x = vector(points, idf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([code[batch.column("lang")[i].as_py()]], pa.int32()), pa.array([at.astype(np.int32).tobytes()]), pa.array([x.astype(np.float32).tobytes()])], ["y", "at", "x"]
            )

    # repeated rows, and copies of one text, are one row of the sample; its order is that of a digest, whatever the ids
    picked = known.where(F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")])
    found = picked.select("lang", "text").mapInArrow(sparse, "y int, at binary, x binary").distinct().collect()
    found.sort(key=lambda r: hashlib.md5(b"%d %b %b" % (r[0], r[1], r[2])).digest())
    rows = [(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32).astype(float), r[0]) for r in found]
    cut = max(1, len(rows) * 4 // 5)
    w = ftrl(rows[:cut], len(languages))
    return languages, idf, w, temperature(rows[cut:], w)


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from those not held out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", "lang")
    languages, idf, w, t = fit(base.where("not held_out"))
    model = docs.sparkSession.sparkContext.broadcast((languages, idf.astype(np.float32), w.astype(np.float32), t))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, idf, w, t = model.value
        for batch in common.blocks(batches):
            texts = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            points, at = code_points(texts)
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for i in np.flatnonzero(lettered) if languages else ():
                z = logits(*vector(points[at[i] : at[i + 1]], idf), w) / t
                p = np.exp(z - z.max())
                best = int(p.argmax())
                langs[i], scores[i] = languages[best], p[best] / p.sum()
            yield common.record(OUT, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=langs, score=scores)

    return base.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"), common.fold("doc_id", 3, 1))

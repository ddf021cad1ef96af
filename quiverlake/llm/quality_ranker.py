"""Operator 2, quality classifier: Bradley-Terry pairwise ranking over features of whole texts.

P(i preferred to j) = sigmoid(w . (x_i - x_j)); preferences pair documents of label 1 with documents of label 0 of a bounded sample. The
features are rates and shares of a text, and the frequencies of its words and pairs of words, hashed. The threshold is a quantile of
the scores of all labelled training documents: its level is the share of label 0 among them, so that as many fall below the threshold
as are of label 0. Scores are shifted so that it lies at 0.7.

Nulls: a null text is scored like an empty one; labels that are neither 0 nor 1 are no labels; with labels of one class or none every
weight is zero and every score is 0.7. Rows without doc_id are scored and not learned from. Rows repeat in the result as in the input,
and a repeated doc_id is learned from with its first text by hash; ties get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytekit import BASE, Block, mix, windows
from .quality_rules import base_columns

#: Bound on the training documents of each class, pairs for each preferred document, ridge penalty, bins of the score distribution.
CLASS_BOUND = 4000
PAIRS_EACH = 8
RIDGE = 1e-4
STEPS = 300
BINS = 1 << 16
CUT = 0.7
#: Buckets of hashed words and pairs of words (bits), and their scale against the rates.
BITS = 15
SCALE = 2.0

NAMES = ("length", "symbols", "dup_lines", "repeats", "upper", "digits", "shouts", "bars", "word_size", "stops", "distinct", "stutter", "odd_bytes", "short")

_byte = np.arange(256)
_UPPER = (_byte >= 65) & (_byte <= 90)
_LETTER = _UPPER | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_DIGIT = (_byte >= 48) & (_byte <= 57)


def features(block: Block) -> np.ndarray:
    """(documents, features): shares and rates, on scales of about 0 to 5."""
    base = base_columns(block)
    n = np.maximum(base["n_words"], 1)
    size = np.maximum(block.sizes, 1)
    start, end = block.words()
    doc = block.document_of(start)
    h = block.span_hash(start, end)
    first = np.unique(h + doc.astype(np.uint64) * BASE, return_index=True)[1]
    distinct = np.bincount(doc[first], minlength=block.n)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.zeros(0, np.int64)
    stutter = np.bincount(doc[same], minlength=block.n)
    of = lambda flags: block.per_document(flags[block.data])
    byte = lambda chars: np.isin(_byte, list(chars))
    rate = lambda count: np.log1p(10 * count / n)
    return np.column_stack([
        np.log1p(base["n_words"]), rate(base["n_symbols"]), rate(base["n_dup_lines"]), base["n_repeat_words"] / n * 3,
        of(_UPPER) / np.maximum(of(_LETTER), 1) * 3, of(_DIGIT) / size * 10, rate(of(byte(b"!?"))), rate(of(byte(b"|"))),
        np.minimum(base["word_chars"] / n, 30) / 5, rate(of(byte(b".,;"))), distinct / n * 3, stutter / n * 3,
        of(byte(b"\\{}[]~^`=_")) / size * 10, (base["n_words"] < 5) * 1.0,
    ]).astype(np.float32)


def hashed(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the words and pairs of words of a lower-cased block; the values of a document have length SCALE."""
    start, end = block.words()
    doc = block.document_of(start)
    word = block.span_hash(start, end)
    first, pair = windows(block, doc, word, 2)
    owner = np.concatenate((doc, doc[first]))
    bucket = (np.concatenate((word, mix(pair + BASE))) >> np.uint64(64 - BITS)).astype(np.int64)
    key, n = np.unique(owner << BITS | bucket, return_counts=True)
    owner, bucket = key >> BITS, key & ((1 << BITS) - 1)
    value = np.log1p(n)
    length = np.sqrt(np.bincount(owner, weights=value * value, minlength=block.n))
    return owner, bucket, SCALE * value / length[owner]


class Rows:
    """Feature rows of documents: dense rates, and sparse hashed words as (row, bucket, value)."""

    def __init__(self, dense: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray):
        self.dense, self.row, self.bucket, self.value = dense, row, bucket, value
        self.width = dense.shape[1] + (1 << BITS)

    @classmethod
    def of(cls, texts: pa.Array) -> "Rows":
        return cls(features(Block(texts)).astype(float), *hashed(Block(texts, lower=True)))

    def times(self, w: np.ndarray) -> np.ndarray:
        """One number for each row: its features times the weights."""
        k = self.dense.shape[1]
        return self.dense @ w[:k] + np.bincount(self.row, weights=self.value * w[k:][self.bucket], minlength=len(self.dense))

    def added(self, g: np.ndarray) -> np.ndarray:
        """One number for each feature: the rows added up with the factors ``g``."""
        return np.concatenate((self.dense.T @ g, np.bincount(self.bucket, weights=self.value * g[self.row], minlength=1 << BITS)))


def preferences(y: np.ndarray, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other) rows: PAIRS_EACH pairs for each row of either class, the partners drawn."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    j, k = rng.integers(0, len(bad), len(good) * PAIRS_EACH), rng.integers(0, len(good), len(bad) * PAIRS_EACH)
    return np.concatenate((np.repeat(good, PAIRS_EACH), good[k])), np.concatenate((bad[j], np.repeat(bad, PAIRS_EACH)))


def fit(x: Rows, y: np.ndarray) -> np.ndarray:
    """Weights of the Bradley-Terry model: the least mean logistic loss of the differences of preference pairs, plus RIDGE / 2 times the squared
    weights of standardised rates and of hashed words, by accelerated gradients."""
    w = np.zeros(x.width)
    i, j = preferences(y)
    if not len(i):
        return w
    scale = np.concatenate((np.maximum(x.dense.std(axis=0), 1e-3), np.ones(1 << BITS)))
    z = Rows(np.clip((x.dense - x.dense.mean(axis=0)) / scale[: x.dense.shape[1]], -5, 5), x.row, x.bucket, x.value)
    size = (z.dense**2).sum(axis=1) + np.bincount(z.row, weights=z.value**2, minlength=len(z.dense))
    rate = 1 / (RIDGE + np.minimum((2 * (size[i] + size[j])).mean(), 4 * size.max()) / 4)
    ahead = w
    for step in range(STEPS):
        s = z.times(ahead)
        p = 1 / (1 + np.exp(-np.clip(s[i] - s[j], -30, 30)))
        g = (np.bincount(i, weights=1 - p, minlength=len(y)) - np.bincount(j, weights=1 - p, minlength=len(y))) / len(i)
        new = ahead + rate * (z.added(g) - RIDGE * ahead)
        ahead, w = new + step / (step + 3) * (new - w), new
    return w / scale


def squashed(raw: np.ndarray | Column):
    """A score on (0, 1), for its bin."""
    return 0.5 + (F.atan(raw / 4) if isinstance(raw, Column) else np.arctan(raw / 4)) / float(np.pi)


def quantile_cut(rows: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(level, raw score at that quantile) from (bin, label 1, label 0): the level is the share of label 0; where no score lies between
    bins the middle is taken."""
    table = np.zeros((BINS, 2))
    for b, *counts in rows:
        table[b] = counts
    total = table.sum()
    wanted = table[:, 1].sum()
    below = np.concatenate(([0], np.cumsum(table.sum(axis=1))))
    edge = (np.searchsorted(below, wanted - 0.5) + np.searchsorted(below, wanted + 0.5, side="left") - 1) / 2
    at = min(max(edge / BINS, 1e-6), 1 - 1e-6)
    return float(wanted / total), float(4 * np.tan((at - 0.5) * np.pi))


def rank(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Every document's doc_id, held_out, score, predicted, raw (the Bradley-Terry score) and level (of the threshold's quantile). Learns
    from labels(doc_id, quality) not held out."""
    spark = docs.sparkSession
    sample = common.labelled_sample(labels, "quality", ~held_out, CLASS_BOUND, 2)
    texts = common.sampled_texts(docs, sample).groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            x = Rows.of(batch.column("text"))
            ends = np.searchsorted(x.row, np.arange(batch.num_rows + 1))
            cells = [[c[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] for c in (x.bucket.astype(np.int32), x.value.astype(np.float32))]
            dense = [r.tobytes() for r in x.dense.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array(c, pa.binary()) for c in (dense, *cells))], ["doc_id", "label", "dense", "bucket", "value"])

    rows = sorted(texts.mapInArrow(measured, "doc_id long, label int, dense binary, bucket binary, value binary").collect())
    dense = np.array([np.frombuffer(r[2], np.float32) for r in rows], float).reshape(-1, len(NAMES))
    bucket, value = [np.frombuffer(r[3], np.int32) for r in rows], [np.frombuffer(r[4], np.float32) for r in rows]
    flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    x = Rows(dense, np.repeat(np.arange(len(rows)), [len(b) for b in bucket]), flat(bucket, np.int64), flat(value, float))
    w = fit(x, np.array([r[1] for r in rows]))
    shared = spark.sparkContext.broadcast(w)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(Rows.of(batch.column("text")).times(shared.value))], ["doc_id", "raw"])

    scored = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, raw double"), "quality-scores")
    gold = labels.where(~held_out & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    counted = (
        scored.join(gold, "doc_id")
        .groupBy(F.least(F.lit(BINS - 1), F.floor(squashed(F.col("raw")) * BINS)).cast("int").alias("bin"))
        .agg(F.count(F.when(F.col("quality") == 1, 1)), F.count(F.when(F.col("quality") == 0, 1)))
    )
    level, at = quantile_cut([tuple(r) for r in counted.collect()]) if w.any() else (0.0, 0.0)
    result = F.lit(1.0) / (1 + F.exp(-(F.col("raw") - F.lit(at)) - F.lit(float(np.log(CUT / (1 - CUT))))))
    # exp and log may miss 0.7 itself by a last digit
    result = F.when(F.col("raw") == F.lit(at), F.lit(CUT)).otherwise(result)
    return scored.select(
        "doc_id", held_out.alias("held_out"), result.alias("score"), (result >= CUT).cast("int").alias("predicted"), "raw", F.lit(float(level)).alias("level")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), common.fold("doc_id", 4, 2))

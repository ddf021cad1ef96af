"""Operator 5, quality rules: heuristics of every whole text, then a hashed n-gram log-likelihood ratio between two multinomials.

Target: byte n-grams of trusted documents; raw: byte n-grams of all documents. A document's verdict is the sum of
log p_target / p_raw over its n-grams, divided by (n-grams + PRIOR), against one threshold for every document: the QUANTILE of the trusted
documents' own ratios, so that a document is kept if it is as likely to be of the target as all but a few of those are.

Trusted are all documents that the labels trust, however many: counts and threshold cover each of them. Only bins of ratios, or HELD of
them at most, reach the driver.

Nulls: a null text is an empty one (no words: it fails the word-count rule). Without trusted documents the base rules decide alone. Rows
repeat in the result as in the input; a trusted document that is repeated counts as often. Texts are never cut, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytekit import BASE, Block, covered, repeated, windows
from .decontamination import small

#: Fixed values of the contract: the symbols counted, the window width, and the limits of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

GRAM = 3
BITS = 16
#: Parameters of the ratio: additive smoothing, the length prior, the threshold's quantile.
SMOOTHING = 1.0
PRIOR = 30.0
QUANTILE = 0.005
#: Bins of one step of the search for the threshold, and ratios that the driver may sort.
BINS = 4096
HELD = 10_000

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_NO_CONTINUATION = (np.arange(256) & 0xC0) != 0x80

OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("n_grams", pa.int64()), ("ratio", pa.float64())]
)


def base_columns(block: Block) -> dict[str, np.ndarray]:
    """The five counts of each document of a block."""
    start, end = block.words()
    doc = block.document_of(start)
    hashes = block.span_hash(start, end)
    n_words = np.bincount(doc, minlength=block.n)
    points = np.concatenate(([0], np.cumsum(_NO_CONTINUATION[block.data], dtype=np.int64)))
    chars = np.bincount(doc, weights=points[end] - points[start], minlength=block.n).astype(np.int64)

    first, h = windows(block, doc, hashes, WINDOW)
    twice = first[repeated(doc[first], h)] if len(first) else first
    again = np.bincount(doc[covered(len(start), twice, WINDOW)], minlength=block.n) if len(start) else np.zeros(block.n, np.int64)

    stop = np.flatnonzero(block.data == 10)
    line = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    before = np.searchsorted(start, line)
    used = np.searchsorted(start, stop) > before
    line, stop = line[used], stop[used]
    owner = block.document_of(line)
    dup = np.zeros(block.n, np.int64)
    if len(line):
        key = block.span_hash(line, stop) + owner.astype(np.uint64) * BASE
        _, at = np.unique(key, return_index=True)
        dup = np.bincount(owner, minlength=block.n) - np.bincount(owner[at], minlength=block.n)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": block.per_document(_IS_SYMBOL[block.data]), "n_dup_lines": dup, "n_repeat_words": again}


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every byte n-gram inside a document."""
    d = block.data.astype(np.uint32)
    n = len(d) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = d[:n].copy()
    for i in range(1, GRAM):
        key = (key << np.uint32(8)) | d[i : n + i]
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    counts = np.maximum(block.sizes - GRAM + 1, 0)
    doc = np.repeat(np.arange(block.n), counts)
    position = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(block.starts, counts)
    return doc, bucket[position]


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of all texts by bucket: partial counts by task, summed by bucket, at most 2**BITS rows to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in common.blocks(batches):
            total += np.bincount(grams(Block(batch.column(0)))[1], minlength=1 << BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(1 << BITS, np.float64)
    for bucket, n in texts.select("text").mapInArrow(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target / p_raw by bucket, with additive smoothing."""
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * len(target))
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    return np.log(p) - np.log(q)


def scores(block: Block, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, length-normalised ratio) of each document."""
    doc, bucket = grams(block)
    n = np.maximum(block.sizes - GRAM + 1, 0)
    return n, np.bincount(doc, weights=weights[bucket], minlength=block.n) / (n + PRIOR)


def lower_quantile(values: DataFrame, quantile: float) -> float:
    """The value of rank floor(quantile * (n - 1)) of the one column, exactly: bins are counted until few enough values are left to be sorted."""
    x = F.col(values.columns[0])
    n, lo, hi = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return -np.inf
    rank = int(quantile * (n - 1))
    while n > HELD and lo < hi:
        found = values.groupBy(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(BINS)).alias("bin")).agg(F.count(x), F.min(x), F.max(x)).collect()
        for _, n, lo, hi in sorted(found):
            if rank < n:
                break
            rank -= n
        values = values.where(x.between(F.lit(lo), F.lit(hi)))
    return lo if lo == hi else sorted(r[0] for r in values.collect())[rank]


def scored(docs: DataFrame, weights: Broadcast) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base columns, base_failed, n_grams, ratio."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            block = Block(batch.column("text"))
            base = base_columns(block)
            n, ratio = scores(block, weights.value)
            failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])
            yield common.record(OUT, doc_id=batch.column("doc_id"), **base, base_failed=failed, n_grams=n, ratio=ratio)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_grams long, ratio double"
    )


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, ids: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base columns, base_failed, kept, n_grams, ratio. ``trusted``: all texts of the target.

    ``ids``: a column doc_id, if ``trusted`` are the rows of ``docs`` that have those; their ratios are then not computed a second time.
    """
    weights = docs.sparkSession.sparkContext.broadcast(ratios(gram_counts(trusted), gram_counts(docs)))
    rows = common.written(scored(docs, weights), "quality-ratios")
    if ids is None:
        own = common.written(scored(trusted.select(F.lit(None).cast("long").alias("doc_id"), "text"), weights), "trusted-ratios")
    else:
        own = rows.join(small(ids), "doc_id", "left_semi")
    # documents of too few words say nothing of the target's ratios
    threshold = lower_quantile(common.written(own.where(F.col("n_words") >= LEAST_WORDS).select("ratio"), "target-ratios"), quantile)
    kept = ~F.col("base_failed") & (F.col("ratio") >= F.lit(float(threshold)))
    return rows.select(*rows.columns[:7], kept.alias("kept"), "n_grams", "ratio")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; trusted are all documents whose label says quality 1."""
    docs = common.table(spark, sf_dir, "documents")
    good = common.table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    owner = small(good.withColumnRenamed("doc_id", "owner"))
    return judge(docs, docs.join(owner, F.col("doc_id").cast("long") == F.col("owner"), "left_semi").select("text"), ids=good)

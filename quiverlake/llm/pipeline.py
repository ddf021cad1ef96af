"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the columns of
``documents``. Between stages the documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlake.session import ship_code

from . import common, decontamination, near_copies, pieces, pii, toxicity

#: Bytes of rows that go to a Python worker at once; Spark's own 64 MB are held by the JVM and by the worker, for each of an executor's cores.
BATCH_BYTES = 4 << 20
#: Text bytes of an encoder's block: less memory than op6's, for some more time.
ENCODE_BYTES = 1 << 18


def ready(spark: SparkSession) -> SparkSession:
    """``spark`` with this package at its workers and batches of bounded size; rows that are larger go alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship_code(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    return toxicity.without_toxic(docs, common.table(ready(spark), sf_dir, "labels"), common.fold("doc_id", 3, 1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one of the smallest doc_id: SimHash fingerprints of five-word shingles compared as bit planes,
    then the exact check for a Jaccard similarity of 0.8 or more."""
    ready(spark)
    return near_copies.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, common.table(ready(spark), sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    ready(spark)
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces and the round trip of every document."""
    ready(spark)
    return pieces.encode(docs, most=ENCODE_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express trained classifiers, similarity components or sampling; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = common.table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

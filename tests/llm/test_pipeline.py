import re
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from quiverlake.llm import common, pieces, pipeline, toxicity

from test_decontamination import plain_windows

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists() or not Path(pieces.MODEL_PATH).exists(), reason="the test tables or tokenizers are not here")


def near_copies(rows):
    """The smallest doc_id of each component of five-word shingle sets at Jaccard 0.8, all pairs compared."""
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x == y or len(x & y) >= 0.8 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {find(i) for i, _ in sets}


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, tables = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(DATA)), name)
        tables[name] = docs
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = {name: {r["doc_id"] for r in t.select("doc_id").collect()} for name, t in tables.items()}
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    clean = toxicity.classify(tables[""], labels, common.fold("doc_id", 3, 1)).where("predicted = 0")
    assert ids["toxicity"] == {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert ids["near_duplicates"] == near_copies([(r["doc_id"], r["text"]) for r in tables["toxicity"].select("doc_id", "text").collect()])
    items = [plain_windows(r["text"], True) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect() if r["text"]]
    for r in tables["near_duplicates"].select("doc_id", "text").collect():
        own = plain_windows(r["text"], True)
        held = any(item and len(own & item) == len(item) for item in items)
        assert held is False or r["doc_id"] not in ids["decontamination"]
        if not any(item and len(own & item) >= 0.5 * len(item) for item in items):
            assert r["doc_id"] in ids["decontamination"]
    assert ids["personal_data"] == ids["sentencepiece"] == ids["decontamination"]
    assert tables["sentencepiece"].where("not lossless").count() == 0


def test_run_takes_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(DATA / f"{t}.parquet")).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_bound_the_rows_of_a_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        docs = spark.range(0, 60, 1, 1).selectExpr("id as doc_id", "repeat(concat(id, ' and '), 40000) as text")
        pipeline.redact_personal_data(spark, docs, "")
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
        assert len(sizes) > 2 and max(r["n"] for r in sizes) < 1.2 * pipeline.BATCH_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)

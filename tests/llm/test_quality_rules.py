import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quiverlake.llm import quality_rules as q
from quiverlake.llm.bytekit import Block


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_columns_against_brute_force():
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "a", "a\n a\na\n\na", "x " * 30, "é ü \x0b漢 字", "a b c d e f\na b c d e f\r\n"]
    texts += ["".join(rng.choices(["a", "b", "cc", " ", " ", "\n", "#", "é", "\t", "a b a b a "], k=rng.randint(0, 60))) for _ in range(300)]
    got = q.base_columns(Block(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), t


def test_verdicts(spark, corpus):
    docs, labels = corpus
    docs = docs.where("doc_id is null or doc_id <> 5003")  # it alone would make up two fifths of the raw n-grams
    good = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id")
    rows = q.judge(docs, good).collect()
    assert len(rows) == docs.count()
    gold = {r["doc_id"]: r["quality"] for r in labels.collect()}
    own = [(r["kept"], gold[r["doc_id"]]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 600 and not r["base_failed"]]
    assert np.mean([k for k, y in own if y == 1]) > 0.99 and np.mean([k for k, y in own if y == 0]) < 0.05
    by = {r["doc_id"]: r for r in rows}
    assert by[5000]["base_failed"] and not by[5000]["kept"] and by[5001]["n_words"] == 0 and by[None]["n_words"] > 0
    assert q.judge(docs.limit(0), good.limit(0)).count() == 0


def test_ratio_is_the_log_likelihood_ratio():
    texts = pa.array(["abcabc", "xyz", "ab"])
    block = Block(texts)
    doc, bucket = q.grams(block)
    assert np.bincount(doc, minlength=3).tolist() == [4, 1, 0]
    assert bucket[0] == bucket[3]
    r = q.ratios(np.bincount(bucket[:4], minlength=1 << q.BITS).astype(float), np.bincount(bucket, minlength=1 << q.BITS).astype(float))
    assert r[bucket[0]] > 0 > r[bucket[4]]


def test_ratio_and_verdict_against_plain_counts(spark, monkeypatch):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "house", "stands", "é", "near"]) for _ in range(rng.randint(5, 60))) for _ in range(40)]
    bad = [" ".join(rng.choice(["zq", "xx", "qj", "the"]) for _ in range(rng.randint(5, 60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad + ["", None])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in q.judge(docs, docs.where("doc_id < 30"), 0.1).collect()}

    def grams(text):
        raw = (text or "").encode()
        return [((int.from_bytes(raw[i : i + 3], "big") * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 2)]

    target, raw = Counter(g for t in good[:30] for g in grams(t)), Counter(g for t in good + bad for g in grams(t))
    size = 1 << q.BITS
    weight = lambda g: math.log((target[g] + 1) / (sum(target.values()) + size)) - math.log((raw[g] + 1) / (sum(raw.values()) + size))
    ratio = {i: sum(map(weight, grams(t))) / (len(grams(t)) + q.PRIOR) for i, t in enumerate(good + bad + ["", None])}
    assert all(abs(got[i]["ratio"] - r) < 1e-9 for i, r in ratio.items())
    trusted = sorted(ratio[i] for i in range(30) if got[i]["n_words"] >= 10)
    least = trusted[math.floor(0.1 * (len(trusted) - 1))]
    assert all(r["kept"] == (not r["base_failed"] and r["ratio"] >= least - 1e-12) for r in got.values())
    assert q.judge(docs, docs.limit(0)).where("kept = base_failed").count() == 0


def test_every_trusted_document_counts(spark, tmp_path):
    # more labelled documents than any sample of 20,000 holds
    words = "transform(sequence(1, 10 + id % 7), i -> substr(sha2(concat(id, '-', i), 256), 1, 1 + cast(id % 5 as int)))"
    docs = spark.range(20_600).selectExpr("id as doc_id", f"array_join({words}, ' ') as text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id", "if(doc_id % 100 = 99, 0, 1) as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def counts(some):
        return np.bincount(np.concatenate([q.grams(Block(pa.array(some[i : i + 4000])))[1] for i in range(0, len(some), 4000)]), minlength=1 << q.BITS)

    weights = q.ratios(counts([t for i, t in texts.items() if i % 100 != 99]), counts(list(texts.values())))
    ratio = {i: q.scores(Block(pa.array([t])), weights)[1][0] for i, t in texts.items()}
    least = np.quantile([r for i, r in ratio.items() if i % 100 != 99], q.QUANTILE, method="lower")
    got = {r["doc_id"]: r for r in q.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(abs(got[i]["ratio"] - r) < 1e-12 for i, r in ratio.items())
    assert all(r["kept"] == (not r["base_failed"] and r["ratio"] >= least - 1e-12) for r in got.values())


def test_quantile_by_bins(spark, monkeypatch):
    monkeypatch.setattr(q, "HELD", 20)
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=1500), np.round(rng.normal(size=900), 1), np.full(300, -0.25), np.array([1e-300, -5.0] * 40), np.array([2.5])):
        table = spark.createDataFrame([(float(v),) for v in x], "ratio double")
        for level in (0.0, 0.005, 0.5, 1.0):
            assert q.lower_quantile(table, level) == np.quantile(x, level, method="lower")
    assert q.lower_quantile(table.limit(0), 0.5) == -np.inf

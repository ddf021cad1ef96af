"""Held-out accuracy, edge cases and independence of partitions of the three trained classifiers."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import common, language, quality_ranker, toxicity

held = lambda i, mod, r: zlib.crc32(str(i).encode()) % mod == r


def accuracy(rows, labels, column):
    gold = {r["doc_id"]: r[column] for r in labels.collect() if r["doc_id"] is not None and r[column] is not None}
    own = [(r["predicted"], gold[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in gold]
    return np.mean([p == y for p, y in own]), len(own)


def test_quality_ranker(spark, corpus):
    docs, labels = corpus
    rows = quality_ranker.rank(docs, labels, common.fold("doc_id", 4, 2)).collect()
    assert len(rows) == docs.count()
    share, n = accuracy(rows, labels, "quality")
    assert n > 100 and share > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows if r["doc_id"] is not None)


def test_quality_ranker_learns_no_held_out_label(spark, corpus):
    docs, labels = corpus
    fold = common.fold("doc_id", 4, 2)
    turned = labels.withColumn("quality", F.when(common.fold("doc_id", 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(str, quality_ranker.rank(docs, labels, fold).select("doc_id", "score").collect()))
    assert a == sorted(map(str, quality_ranker.rank(docs, turned, fold).select("doc_id", "score").collect()))


def test_quality_ranker_without_labels(spark, corpus):
    docs, labels = corpus
    rows = quality_ranker.rank(docs, labels.limit(0), common.fold("doc_id", 4, 2)).collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows}) == 1
    assert quality_ranker.rank(docs.limit(0), labels, common.fold("doc_id", 4, 2)).count() == 0


def plain_pairwise_fit(z, i, j, ridge):
    """Newton steps on the written-out differences."""
    d = z[i] - z[j]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), d.T @ (1 - p) / len(d) - ridge * w)
    return w


def test_bradley_terry_against_a_plain_fit(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(quality_ranker, "BITS", 3)
    monkeypatch.setattr(quality_ranker, "STEPS", 5000)
    monkeypatch.setattr(quality_ranker, "RIDGE", 1e-2)
    dense, row = rng.standard_normal((300, 4)) * [1, 2, 0.5, 3], np.repeat(np.arange(300), 2)
    x = quality_ranker.Rows(dense, row, rng.integers(0, 8, 600), rng.random(600))
    wide = np.zeros((300, 12))
    wide[:, :4] = dense
    np.add.at(wide, (x.row, 4 + x.bucket), x.value)
    y = (wide @ rng.standard_normal(12) + rng.standard_normal(300) > 0).astype(int)
    assert np.allclose(x.times(np.arange(12.0)), wide @ np.arange(12.0))
    z = wide.copy()
    z[:, :4] = np.clip((dense - dense.mean(axis=0)) / dense.std(axis=0), -5, 5)
    want = plain_pairwise_fit(z, *quality_ranker.preferences(y), 1e-2)
    want[:4] /= dense.std(axis=0)
    assert np.allclose(quality_ranker.fit(x, y), want, atol=1e-4)


def test_threshold_is_the_quantile_of_label_0():
    rng = np.random.default_rng(1)
    raw = np.concatenate((rng.normal(-3, 1, 700), rng.normal(3, 1, 1300)))
    y = np.repeat([0, 1], [700, 1300])
    bins = (quality_ranker.squashed(raw) * quality_ranker.BINS).astype(int)
    rows = [(int(b), int((y[bins == b] == 1).sum()), int((y[bins == b] == 0).sum())) for b in np.unique(bins)]
    level, at = quality_ranker.quantile_cut(rows)
    assert level == 0.35 and abs((raw < at).sum() - 700) <= 2


def test_toxicity(spark, corpus):
    docs, labels = corpus
    fold = common.fold("doc_id", 3, 1)
    rows = toxicity.classify(docs, labels, fold).collect()
    assert len(rows) == docs.count()
    share, n = accuracy(rows, labels, "toxic")
    assert n > 100 and share > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    rejected = {r["doc_id"] for r in rows if r["predicted"]}
    kept = toxicity.without_toxic(docs, labels, fold)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows} - rejected


def test_toxicity_without_labels_uses_the_list(spark, corpus):
    docs, labels = corpus
    extra = spark.createDataFrame([(1, "you idiot and clown"), (2, "a fine day")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(extra, labels.limit(0), common.fold("doc_id", 3, 1)).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.classify(docs.limit(0), labels, common.fold("doc_id", 3, 1)).count() == 0


def test_posteriors_use_no_labels(spark, corpus):
    docs, labels = corpus
    fold = common.fold("doc_id", 3, 1)
    stems, w, cut = toxicity.fit(docs, labels, fold)
    assert "zwac" in stems and all(w[:-1] >= 0)
    rng = np.random.default_rng(0)
    y = rng.random(500) < 0.1
    x = np.where(y[:, None], rng.random((500, 6)) < 0.6, rng.random((500, 6)) < 0.02)
    n = rng.integers(1, 4, 500).astype(float)
    many = toxicity.label_model(np.repeat(x, n.astype(int), axis=0))
    assert np.allclose(toxicity.label_model(x, n), many[np.cumsum(n.astype(int)) - 1], atol=1e-6)
    assert ((toxicity.label_model(x, n) > 0.5) == y).mean() > 0.95


def test_label_model_finds_accurate_and_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    vote = lambda hit, false: np.where(y, rng.random(3000) < hit, rng.random(3000) < false)
    a, b, c = vote(0.8, 0.02), vote(0.7, 0.03), vote(0.75, 0.02)
    v = np.column_stack([a, b, c, c, c])  # one voter three times over
    q = toxicity.label_model(v)
    assert ((q > 0.5) == y).mean() > 0.95
    parent = toxicity.dependency_tree(v.astype(float), q)
    assert (parent[3] in (2, 4)) and (parent[4] in (2, 3))


def test_language(spark, corpus):
    docs, _ = corpus
    rows = {}
    for r in language.identify(docs, common.fold("doc_id", 3, 1)).collect():
        rows[r["doc_id"]] = r
    gold = {r["doc_id"]: r["lang"] for r in docs.collect()}
    own = [r["lang_pred"] == gold[i] for i, r in rows.items() if i is not None and i < 600 and r["held_out"]]
    assert len(own) > 100 and np.mean(own) > 0.98
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (5000, 5001, 5002))
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_without_training(spark, corpus):
    docs, _ = corpus
    got = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), common.fold("doc_id", 3, 1)).select("lang_pred").distinct().collect()
    assert [r[0] for r in got] == ["und"]
    assert language.identify(docs.limit(0), common.fold("doc_id", 3, 1)).count() == 0


def test_language_takes_rows_without_id(spark, corpus):
    docs, _ = corpus
    more = docs.unionByName(docs.where("doc_id < 40").withColumn("doc_id", F.lit(None).cast("long")))
    rows = language.identify(more, common.fold("doc_id", 3, 1)).collect()
    assert len(rows) == more.count() and not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_tf_idf_against_plain_counts():
    texts = ["The café, 12!", "", "aaa", None]
    points, at = language.code_points(pa.array(texts))
    idf = np.random.default_rng(0).random(1 << language.BITS) + 0.5
    for k, text in enumerate(texts):
        plain = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        grams = Counter(plain[i : i + n] for n in language.ORDERS for i in range(len(plain) - n + 1))
        want = {}
        for g, n in grams.items():
            used, _ = language.counts(np.array([ord(c) for c in g], np.uint32))
            h = np.uint32(len(g))
            for c in g:
                h = np.uint32(((int(h) ^ ord(c)) * 0x01000193 + 0x9E3779B9) & 0xFFFFFFFF)
            bucket = ((int(h) * 2654435761) & 0xFFFFFFFF) >> (32 - language.BITS)
            assert bucket in used
            want[bucket] = want.get(bucket, 0) + n
        want = {b: math.log1p(n) * idf[b] for b, n in want.items()}
        norm = math.sqrt(sum(v * v for v in want.values())) or 1
        used, x = language.vector(points[at[k] : at[k + 1]], idf)
        assert dict(zip(used.tolist(), x.tolist(), strict=True)) == pytest.approx({b: v / norm for b, v in want.items()})


def test_ftrl_against_plain_updates():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(30, 5, replace=False)), rng.random(5), int(rng.integers(3))) for _ in range(40)]
    got = language.ftrl(rows, 3)
    z, n, order = {}, {}, np.random.default_rng(9)

    def weight(key):
        if abs(z.get(key, 0)) <= language.L1:
            return 0.0
        sign = 1 if z[key] > 0 else -1
        return -(z[key] - sign * language.L1) / ((language.BETA + math.sqrt(n[key])) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            items = [*zip(at.tolist(), x.tolist(), strict=True), (1 << language.BITS, 0.3)]
            w = {(i, c): weight((i, c)) for i, _ in items for c in range(3)}
            e = [math.exp(sum(v * w[i, c] for i, v in items)) for c in range(3)]
            for i, v in items:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    before = n.get((i, c), 0.0)
                    n[i, c] = before + g * g
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(n[i, c]) - math.sqrt(before)) / language.ALPHA * w[i, c]
    for i in [*range(30), 1 << language.BITS]:
        assert got[i] == pytest.approx([weight((i, c)) for c in range(3)], abs=1e-9)


def test_temperature_calibrates():
    rows = [(np.array([0]), np.array([1.0]), int(i % 4 == 0)) for i in range(400)]
    w = np.zeros(((1 << language.BITS) + 1, 2))
    w[0] = [5.5, 0.0]  # far too sure of class 0, which is right three times in four
    t = language.temperature(rows, w)
    p = 1 / (1 + np.exp(-5.5 / t))
    assert abs(p - 0.75) < 0.03

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import common, seating
from quiverlake.llm import pitman_yor as p
from quiverlake.llm.seating import tables


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_base_columns_and_perplexity(spark, corpus, monkeypatch):
    docs, _ = corpus
    rows = [r for r in docs.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for r in rows if not held(r["doc_id"]) for w in split(r["text"]))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        t = split(r["text"])
        want[r["doc_id"], held(r["doc_id"]), len(t), sum(w in count for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)] += 1
    got = p.score(docs, common.fold("doc_id", 5, 1)).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    own = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)
    assert all(r["score"] <= 0 for r in got)


def test_result_does_not_depend_on_buckets_or_chunks(spark, corpus):
    docs, _ = corpus
    some = docs.where("doc_id < 120 or doc_id is null")
    want = None
    for parts, shuffled in ((1, 4), (6, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        try:
            got = sorted(((str(r["doc_id"]), r["base_score"], r["score"]) for r in p.score(some.repartition(parts), common.fold("doc_id", 5, 1)).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        if want:
            assert [r[0] for r in got] == [r[0] for r in want]
            assert np.allclose([r[1:] for r in got], [r[1:] for r in want], rtol=0, atol=1e-9)
        want = got


def all_probabilities(buckets, state):
    """In place of ``finished``, for one chunk: the probability of every word, and of an unknown one, after every context."""
    import numpy as np
    import pyarrow as pa

    from quiverlake.llm import common
    from quiverlake.llm import pitman_yor as p

    def run(number, rows):
        chunk = p.unpacked_chunk(rows[0][1])[0]
        kinds = [[(b, body) for b, body in rows if k * buckets <= b < (k + 1) * buckets] for k in range(3)]
        total = p.totals_of(kinds[0])[0]
        drawn = len(state["samples"]) // 2
        n, *samples = p.word_answers(kinds[1], drawn)
        t = (total > 0).astype(float)
        if kinds[2]:
            t[total > 1] = np.concatenate([p.unpack(body, np.int64)[0] for _, body in kinds[2]]) / drawn
        width = len(chunk.words)
        dense = np.zeros((2, width, width + 1))
        dense[0][chunk.context, chunk.word], dense[1][chunk.context, chunk.word] = total, t
        n, samples = np.append(n, 0), [np.append(x, 0) for x in samples]
        words = np.append(np.flatnonzero((n[:-1] > 0) & (np.arange(width) != chunk.start)), width)
        for u in np.flatnonzero((n[:-1] > 0) & (chunk.words != p.END)):
            prob = p.predictive(np.full(len(words), u), words, dense[0][u, words], dense[1][u, words], n, samples, state)
            size = len(words)
            yield common.record(
                p.OUT, doc_id=np.full(size, int(chunk.words[u].view(np.int64))), held_out=np.zeros(size, bool), n_tokens=np.append(chunk.words.view(np.int64), 0)[words],
                n_known=dense[0][u, words].astype(np.int64), train_tokens=n[words], base_score=np.full(size, float(n[u])), score=prob,
            )

    return run


def local(function):
    """A copy of a function that is sent to workers by value."""
    import types

    out = types.FunctionType(function.__code__, {"__builtins__": __builtins__}, function.__name__)
    out.__module__ = "__main__"
    return out


def test_probabilities_of_every_context_add_up_to_one(spark, corpus, monkeypatch):
    docs, _ = corpus
    monkeypatch.setattr(p, "finished", local(all_probabilities))
    rows = p.score(docs.where("doc_id < 40").coalesce(1), common.fold("doc_id", 5, 1)).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["score"]
        assert r["score"] > 0
    assert len(total) > 300 and all(abs(x - 1) < 1e-9 for x in total.values())


def plain_sampler(texts, d, sweeps, rng):
    """Customers one by one, removed and seated again, with every table's size kept: the mean probability of each (context, word)."""
    pairs = [pair for t in texts for pair in zip([0, *t.split()], [*t.split(), None], strict=True)]
    words = sorted({w for _, w in pairs}, key=str)
    low, top = {}, {}
    parent = lambda w: (sum(top.get(w, [])) - d[0] * len(top.get(w, [])) + (1 + d[0] * sum(map(len, top.values()))) / (len(words) + 1)) / (1 + sum(map(sum, top.values())))
    tables_of = lambda u: sum(len(x) for (v, _), x in low.items() if v == u)

    def seat(sizes, discount, new):
        weights = [max(s - discount, 0) for s in sizes] + [new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(sizes):
            sizes.append(0)
        sizes[k] += 1
        return k == len(sizes) - 1 and sizes[k] == 1

    def leave(sizes):
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    def arrive(u, w):
        if seat(low.setdefault((u, w), []), d[1], (1 + d[1] * tables_of(u)) * parent(w)):
            seat(top.setdefault(w, []), d[0], (1 + d[0] * sum(map(len, top.values()))) / (len(words) + 1))

    for u, w in pairs:
        arrive(u, w)
    mean, kept = Counter(), 0
    count, full = Counter(pairs), Counter(u for u, _ in pairs)
    for sweep in range(sweeps):
        for u, w in pairs:
            if leave(low[u, w]):
                leave(top[w])
            arrive(u, w)
        if sweep >= sweeps // 4:
            kept += 1
            for u, w in count:
                mean[u, w] += (count[u, w] - d[1] * len(low[u, w]) + (1 + d[1] * tables_of(u)) * parent(w)) / (1 + full[u])
    return {k: v / kept for k, v in mean.items()}, d


def test_small_corpus_against_a_plain_sampler(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c"]) + rng.choice(["", "x"]) for _ in range(6)) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    seen = {}
    original = p.finished

    def finished(buckets, state):
        seen.update(state)
        return original(buckets, state)

    monkeypatch.setattr(p, "finished", finished)
    monkeypatch.setattr(p, "SAMPLES", 300)
    got = {r["doc_id"]: r["score"] for r in p.score(docs, F.lit(False)).collect()}
    mean, _ = plain_sampler(texts, seen["discount"], 400, rng)
    want = {i: sum(math.log10(mean[pair]) for pair in zip([0, *t.split()], [*t.split(), None], strict=True)) for i, t in enumerate(texts)}
    assert max(abs(got[i] - want[i]) / 7 for i in want) < 0.02
    assert abs(sum(got.values()) - sum(want.values())) / len(texts) / 7 < 0.005


def test_empty_table(spark, corpus):
    docs, _ = corpus
    assert p.score(docs.limit(0), common.fold("doc_id", 5, 1)).count() == 0
    none = p.score(docs.where("doc_id is not null").limit(5), F.lit(True)).collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in none)


def exact_weights(c, rest, base, strength, d):
    """Weights of 1 ... c tables, by the recursion over customers, in logarithms."""
    row = np.zeros(1)
    for n in range(1, c):
        t = np.arange(1, n + 1)
        row = np.logaddexp(np.append(row + np.log(n - d * t), -np.inf), np.concatenate(([-np.inf], row)))
    log = row + np.cumsum(np.log((strength + d * (rest + np.arange(c))) * base))
    w = np.exp(log - log.max())
    return w / w.sum()


@pytest.mark.parametrize(("c", "rest", "base"), [(2, 3, 0.1), (7, 0, 0.3), (40, 100, 0.05), (400, 20, 0.01), (3000, 5000, 0.02), (6000, 5, 1e-4), (6000, 2, 0.3), (6000, 3000, 0.02), (6000, 30000, 0.02)])
def test_tables_are_drawn_from_their_weights(c, rest, base):
    n = 4000
    w = exact_weights(c, rest, base, 1.0, 0.6)
    t = np.arange(1, c + 1)
    mean, sd = (w * t).sum(), ((w * t * t).sum() - (w * t).sum() ** 2) ** 0.5
    got = tables(np.full(n, c), np.full(n, float(rest)), np.full(n, base), 1.0, 0.6, np.arange(n, dtype=np.uint64))
    assert abs(got.mean() - mean) < 5 * sd / n**0.5 + (0.01 * mean if c > seating.EXACT else 1e-9)
    assert abs(got.std() - sd) < 0.1 * sd + 0.02


def test_one_customer_has_one_table():
    got = tables(np.array([0, 1, 2]), np.zeros(3), np.full(3, 1e-12), 1.0, 0.5, np.arange(3, dtype=np.uint64))
    assert got.tolist() == [0, 1, 1]

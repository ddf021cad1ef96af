import hashlib
import random

import pytest

from quiverlake.llm import suffix_dedup as s


def brute(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for t, g in zip(texts, gone, strict=True):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((len(t), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(t, g, strict=True) if not x)).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é\n"
    word = lambda n: "".join(rng.choices(letters, k=n))
    shared = [word(rng.choice([150, 199, 200, 201, 260, 700])) for _ in range(6)]
    docs = [None, "", "short", word(199), "ab" * 300, "x" * 199, "x" * 200, "y" * 201]
    for _ in range(40):
        docs.append("".join(rng.choice([word(rng.randint(0, 300)), rng.choice(shared), rng.choice(shared)[20:]]) for _ in range(rng.randint(1, 5))))
    docs += [docs[12], docs[12] + "!", docs[20]]
    return docs


@pytest.mark.parametrize("hot", [5000, 0, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(s, "CHUNK_BYTES", 3000)
    docs = made(hot)
    rows = spark.createDataFrame([(i if i != 9 else None, t, 7) for i, t in enumerate(docs)], "doc_id long, text string, n_bytes int").repartition(3)
    original = s.counted

    def counted(bucket, rows):
        s.HOT = hot  # in the worker, where the limit is read
        return original(bucket, rows)

    monkeypatch.setattr(s, "counted", counted)
    got = {r["doc_id"]: tuple(r)[1:] for r in s.dedup(rows).collect()}
    want = brute([(t or "").encode() for t in docs], s.LENGTH)
    assert got == {(i if i != 9 else None): w for i, w in enumerate(want)}


def test_merge_gives_sorted_keys_and_true_prefixes():
    rng = random.Random(4)
    for k in (1, 2, 3, 7, 8):
        runs = []
        for _ in range(k):
            keys = sorted({bytes(rng.choices(b"ab", k=s.KEY - 4)) + b"\0\0\1\2" if rng.random() < 0.5 else b"a" * 300 + bytes(rng.choices(b"ab", k=s.KEY - 300)) for _ in range(rng.randint(0, 30))})
            common = [0] + [next(i for i in range(s.KEY) if a[i] != b[i]) for a, b in zip(keys, keys[1:])]
            runs.append((keys, common[: len(keys)]))
        out = [(runs[r][0][i], p) for r, i, p in s.merge(runs)]
        assert [x for x, _ in out] == sorted(x for r in runs for x in r[0])
        for (a, _), (b, p) in zip(out, out[1:]):
            assert p == next((i for i in range(s.KEY) if a[i] != b[i]), s.KEY)


def test_empty_table(spark):
    assert s.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=900))
    long = "".join(rng.choices("abcdefghij klmnop", k=60_000))
    docs = [long[:30_000] + passage + long[30_000:] + passage, "x" * 5000, passage + "end", long[1000:1150]]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in s.dedup(rows).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in docs], s.LENGTH)))

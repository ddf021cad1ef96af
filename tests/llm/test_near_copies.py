import numpy as np

from quiverlake.llm import near_copies, pipeline


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    rows = [(0, None), (1, ""), (2, "one Two"), (3, "ONE  two"), (4, "one two three")]
    for i in range(10, 60):
        text = list(rng.choice(words, 150))
        rows.append((i, " ".join(text)))
        for copy, changes in enumerate(range(1, 6)):
            other = list(text)
            for at in rng.choice(150, changes, replace=False):
                other[at] = "changed"
            rows.append((1000 * (copy + 1) + i, " ".join(other).upper()))
    return [*rows, (None, rows[9][1])]


def test_stage_drops_all_texts_of_similarity(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, body string")
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(brute(rows))


def test_split_groups_give_the_same(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("SKETCHES", 2), ("SETS", 2)):
        monkeypatch.setattr(near_copies, name, value)
    assert {r["doc_id"] for r in near_copies.without_copies(docs).collect()} == brute(rows)


def test_empty_table(spark):
    assert near_copies.without_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_and_not_ids_are_kept(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 2), (None, c, 3), (None, c, 3), (None, a, 4), (7, None, 5), (8, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row int")
    kept = near_copies.without_copies(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, a, 0), (5, b, 2), (None, c, 3), (7, None, 5)], key=str)


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(2)
    size = [0, 1, 4, 0, 255, 256, 700]
    owner = np.repeat(np.arange(len(size)), size)
    h = rng.integers(0, 2**63, len(owner), dtype=np.uint64)
    got = near_copies.fingerprints(owner, h, len(size))
    assert got.shape == (len(size), near_copies.WORDS)
    for w in range(near_copies.WORDS):
        voters = [int(x) for x in near_copies.mix(h ^ near_copies.DRAW[w])]
        for d, n in enumerate(size):
            mine = [v for v, o in zip(voters, owner, strict=True) if o == d]
            assert int(got[d, w]) == sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in mine) > n)


def bits(fp, i, j):
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(fp[i], fp[j], strict=True))


def test_planes_of_wide_fingerprints_link_by_radius():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (30, near_copies.WORDS), dtype=np.uint64)
    fp = base[rng.integers(0, 30, 300)]
    for i in range(len(fp)):
        for k in rng.choice(256, rng.integers(0, 60), replace=False):
            fp[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    edge = np.array([0, 1, 70, 200])
    group = np.searchsorted(edge, np.arange(300), side="right")
    want = near_copies.stars(np.arange(300), *np.array([(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and bits(fp, i, j) <= near_copies.RADIUS]).T)
    for at_once in (1, 7, 1 << 13):
        near_copies.AT_ONCE, before = at_once, near_copies.AT_ONCE
        try:
            got = near_copies.stars(np.arange(300), *near_copies.alike_prints([x.tobytes() for x in fp], edge))
        finally:
            near_copies.AT_ONCE = before
        assert (got == want).all()


def test_radius_reaches_the_similarity():
    rng = np.random.default_rng(7)
    for shared, left, right in ((4, 0, 1), (8, 1, 1), (8, 0, 2), (12, 0, 3), (40, 0, 10), (80, 10, 10), (400, 50, 50)):
        far = 0
        for _ in range(300):
            h = rng.integers(0, 2**63, shared + left + right, dtype=np.uint64)
            both = np.concatenate((h[: shared + left], h[:shared], h[shared + left :]))
            fp = near_copies.fingerprints(np.repeat([0, 1], [shared + left, shared + right]), both, 2)
            far += bits(fp, 0, 1) > near_copies.RADIUS
        assert far == 0
    h = rng.integers(0, 2**63, 100_000, dtype=np.uint64)
    fp = near_copies.fingerprints(np.repeat(np.arange(1000), 100), h, 1000)
    assert min(bits(fp, 0, j) for j in range(1, 1000)) > near_copies.RADIUS

import re

import numpy as np
import xxhash

from quiverlake.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_pairs_equal_bit_counts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    a = base[rng.integers(0, 40, 700)]
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            a[i] ^= np.uint64(1) << np.uint64(bit)
    begin = rng.integers(0, 700, 700)
    stop = np.minimum(begin + rng.integers(0, 300, 700), 700)
    for radius in (0, 3, 4, 6):
        got = set(zip(*(x.tolist() for x in simhash.near_pairs(a, begin, stop, radius)), strict=True))
        assert got == {(i, j) for i in range(700) for j in range(begin[i], stop[i]) if (int(a[i]) ^ int(a[j])).bit_count() <= radius}


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one Two"), (3, "ONE two"), (4, " \n\t "), (4000, "w1 " * 50_000)]
    for i in range(5, 120):
        text = " ".join(rng.choice(words, 60))
        rows.append((i, text))
        if i % 3 == 0:
            rows.append((1000 + i, text.upper().replace(" ", "  ")))
        if i % 5 == 0:
            rows.append((2000 + i, text + " extra"))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: (prints[i], find(i)) for i in prints}


def test_links_through_rows_without_id(spark):
    prints = {1: 0, 2: 0b111111, None: 0b111, 5: 1 << 60 | 0xFFFF00000}
    table = spark.createDataFrame(list(prints.items()), "doc_id long, fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(table.select("fp"), 4)).collect()}
    assert roots == {0b111: 0, 0b111111: 0}
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(3, text), (3, text), (1, text + " "), (7, "quite another text " * 9), (None, text), (9, None), (8, ""), (None, "no id here " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted([(3, 1), (3, 1), (1, 1), (7, 7), (None, 1), (9, 8), (8, 8), (None, None)], key=str)


def test_hot_keys_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3 if i < 30 else i) for i in range(60)], "doc_id long, fp long")
    named = rows.groupBy("fp").count().withColumnRenamed("count", "n").selectExpr("fp", "n", "fp * 10 as x")
    for share in (1, 10, 1000):
        monkeypatch.setattr(simhash, "HOT_KEYS", share)
        got = simhash.with_hot_keys(rows, named, "fp", 60).collect()
        assert sorted((r["doc_id"], r["x"]) for r in got) == [(i, 10 * (i % 3 if i < 30 else i)) for i in range(60)]


def test_split_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    prints = [(1 << i) for i in range(40)] + [0]
    reps = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(reps, len(prints))).collect()}
    assert set(roots.values()) == {0} and len(roots) == 40


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0

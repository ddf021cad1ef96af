"""Operator 8, SimHash near-duplicates: fingerprints of whole texts, linked by bit-sliced comparison, joined into components.

Distinct fingerprints are cut into ``m`` blocks of bits; two that differ in at most RADIUS bits agree in ``m - RADIUS`` blocks at least,
so every choice of that many blocks is a key and no link is lost. The fingerprints of a task are stored vertically, as 64 bit planes in
which a word holds one bit of 64 fingerprints. A fingerprint is compared with the words of its key's others: a plane is inverted where
its own bit is set, carry-save adders count the differing bits of 64 lanes at once, and words in which every lane exceeds the radius are
abandoned. A key with more than GROUP fingerprints is split into parts, and each pair of parts is a task of its own. A task returns a
star for each of its local components, never all pairs; components of the whole come from alternating star contractions.

Nulls: a null text has no words, so its fingerprint is zero, and all such texts link. Links are between fingerprints, so rows without
doc_id link like any other; they are never the smallest id, and a component without any id has the component_id null. Repeated rows
stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytekit import Block

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a key that one task compares with each other, and words of 64 lanes (or pairs) held at once.
GROUP = 4096
PAIRS_AT_ONCE = 1 << 19
#: Planes added between two looks at which words are still alive.
STRIDE = 9
#: Fingerprints with more than this share (one in so many) of all rows are broadcast.
HOT_KEYS = 10_000


#: The bits of a byte as eight bytes, so that one addition counts eight bits; a byte counts to 255.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(256)
MOST_COUNTED = 255


def majority(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` documents the bits that over half of its hashes have set; the hashes of an owner follow each other."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    size = np.diff(np.append(edge, len(h)))
    piece = np.flatnonzero((np.arange(len(h)) - np.repeat(edge, size)) % MOST_COUNTED == 0)
    counted = np.add.reduceat(SPREAD[h.astype("<u8").view(np.uint8).reshape(-1, 8)], piece, axis=0).view(np.uint8)
    ones = np.add.reduceat(counted, np.searchsorted(piece, edge), axis=0, dtype=np.int64)
    out[owner[edge]] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(block: Block) -> np.ndarray:
    """The fingerprint of each document of a lower-cased block."""
    start, end = block.words()
    if not len(start):
        return np.zeros(block.n, np.uint64)
    doc = block.document_of(start)
    kept = np.zeros(len(block.data), bool)
    inside = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    kept[:] = np.cumsum(inside[:-1]) > 0
    kept[end] = True
    place = np.cumsum(kept) - 1
    joined = block.data[kept]
    joined[place[end]] = 32
    text = joined.tobytes()
    size = np.bincount(doc, minlength=block.n)
    head = np.cumsum(size) - size
    last = np.minimum(np.arange(len(start)) + SHINGLE, head[doc] + size[doc]) - 1
    first = np.flatnonzero((last - np.arange(len(start)) == SHINGLE - 1) | ((size[doc] < SHINGLE) & (np.arange(len(start)) == head[doc])))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(place[start[first]].tolist(), place[end[last[first]]].tolist(), strict=True)), np.uint64, len(first))
    return majority(doc[first], h, block.n)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            fp = fingerprints(Block(batch.column("text"), lower=True)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit words: (64, len / 64) words, by a butterfly transposition of 64 by 64 bit squares; lanes from the top bit down."""
    m = np.zeros((-(-len(x) // 64), 64), np.uint64)
    m.reshape(-1)[: len(x)] = x
    j, mask = 32, np.uint64(0x00000000FFFFFFFF)
    while j:
        v = m.reshape(len(m), 64 // (2 * j), 2, j)
        t = (v[:, :, 0] ^ (v[:, :, 1] >> np.uint64(j))) & mask
        v[:, :, 0] ^= t
        v[:, :, 1] ^= t << np.uint64(j)
        j >>= 1
        mask ^= mask << np.uint64(j)
    return np.ascontiguousarray(m.T)


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def lanes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Words with the lanes [lo, hi) set, lanes from the top bit down; lo and hi are cut to 0 to 64."""
    below = lambda k: np.where(k >= 64, np.uint64(0), ALL >> np.clip(k, 0, 63).astype(np.uint64))
    return below(lo) & ~below(hi)


def near_lanes(vertical: np.ndarray, word: np.ndarray, own: np.ndarray, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each comparison k the lanes of ``wanted[k]`` in which word ``word[k]`` of the planes differs from ``own[k]`` in at most ``radius`` bits.

    ``own[k]`` is a fingerprint: one word, or as many as there are squares of 64 planes.
    """
    bits = len(vertical)
    own = np.ascontiguousarray(own.reshape(len(word), bits // 64).T)
    result = np.zeros(len(word), np.uint64)
    alive = np.flatnonzero(wanted)
    count = [np.zeros(len(alive), np.uint64) for _ in range(max(3, radius.bit_length()))]
    over = np.zeros(len(alive), np.uint64)
    near = wanted[alive]
    stride = STRIDE * len(own)
    for at in range(0, bits, stride):
        w, mine = word[alive], own[:, alive]
        for p in range(at, min(at + stride, bits), 3):
            # a plane is inverted where the own bit is set: 0 - 1 has all bits
            x, y, z = (vertical[q][w] ^ (np.uint64(0) - (mine[q // 64] >> np.uint64(63 - q % 64) & np.uint64(1))) if q < bits else np.uint64(0) for q in (p, p + 1, p + 2))
            half = x ^ y
            one, two = half ^ z, (x & y) | (half & z)
            carry = count[0] & one
            count[0] ^= one
            twice = count[1] ^ two
            up = (count[1] & two) | (twice & carry)
            count[1] = twice ^ carry
            for k in range(2, len(count)):
                count[k], up = count[k] ^ up, count[k] & up
            over |= up
        above, equal = over.copy(), ~over
        for k in reversed(range(len(count))):
            limit = ALL if radius >> k & 1 else np.uint64(0)
            above |= equal & count[k] & ~limit
            equal &= ~(count[k] ^ limit)
        near = near & ~above
        going = np.flatnonzero(near)
        if len(going) < len(alive):
            alive, over, near = alive[going], over[going], near[going]
            count = [c[going] for c in count]
        if not len(alive):
            return result
    result[alive] = near
    return result


def pair_blocks(fp: np.ndarray, begin: np.ndarray, stop: np.ndarray, radius: int = RADIUS, at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with begin[i] <= j < stop[i] whose fingerprints, rows of one or more words, differ in at most ``radius`` bits; in blocks."""
    vertical = np.concatenate([planes(x) for x in fp.reshape(len(fp), -1).T])
    first = begin // 64
    n = np.where(stop > begin, (stop - 1) // 64 - first + 1, 0)
    at = np.concatenate(([0], np.cumsum(n)))
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + at_once, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        word = first[i] + np.arange(len(i)) - np.repeat(at[lo:hi] - at[lo], n[lo:hi])
        near = near_lanes(vertical, word, fp[i], lanes(begin[i] - 64 * word, stop[i] - 64 * word), radius)
        hit = np.flatnonzero(near)
        k, lane = np.nonzero(np.unpackbits(near[hit].astype(">u8").view(np.uint8)).reshape(-1, 64))
        yield i[hit][k], 64 * word[hit][k] + lane
        lo = hi


def near_pairs(fp: np.ndarray, begin: np.ndarray, stop: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``pair_blocks``."""
    found = list(pair_blocks(fp, begin, stop, radius)) if len(fp) else []
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stars(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the smallest label of its component under the links (a[i], b[i])."""
    label = label.copy()
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if (label == before).all():
            break
    return label


def linked(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, part, fp) sorted by key, lo, hi, part -> star links (u, v), v < u, of each group's components."""

    def solve(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, lo, hi, part, fp = (np.concatenate(c) for c in zip(*rows, strict=True))
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        size = np.diff(np.append(edge, len(key)))
        stop = np.repeat(edge + size, size)
        # a part is compared with itself, or the first of two parts with the second, which begins behind it
        second = np.repeat(edge + np.add.reduceat((part == lo).astype(np.int64), edge), size)
        begin = np.where(lo == hi, np.arange(len(key)) + 1, np.where(part == lo, second, stop))
        a, b = near_pairs(fp.view(np.uint64), begin, stop, radius)
        label = stars(fp, a, b)
        moved = label < fp
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(label[moved])], ["u", "v"])

    held: list[np.ndarray] = []
    total = 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        held.append(cols)
        total += batch.num_rows
        if total < 4 * GROUP:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        same = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield solve([[c[:cut] for c in cols]])
        held, total = [[c[cut:] for c in cols]], total - cut
    if held:
        yield solve(held)


def block_count(n: int, radius: int = RADIUS) -> int:
    """The number of bit blocks of least work for ``n`` fingerprints: rows shipped, plus comparisons at a fiftieth of a row's cost."""
    return min(range(radius + 1, 2 * radius + 3), key=lambda m: comb(m, radius) * (1 + n / 2 ** (64 * (m - radius) / m) / 50))


def keys(fp: Column, m: int, radius: int = RADIUS) -> Column:
    """An array of keys: the bits of each choice of ``m - radius`` of ``m`` blocks, with the choice's number mixed in."""
    edges = [64 * i // m for i in range(m + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(m), m - radius)):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        out.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*out)


def links(prints: DataFrame, n: int) -> DataFrame:
    """Star links (u, v) between ``n`` distinct fingerprints; prints: fp."""
    keyed = prints.select("fp", F.explode(keys(F.col("fp"), block_count(n))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(GROUP))
    part = F.pmod(F.xxhash64(F.lit(8), "fp"), parts)
    tasks = (
        keyed.join(sizes, "key")
        .select("key", "fp", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
        .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "fp")
    )
    return tasks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "part").mapInArrow(linked, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large and small stars; nodes without links are left out."""
    edges = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = common.written(small, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def with_hot_keys(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``named``, one row for each value of ``key`` and ``n``, how many rows have it.

    Keys of more than a HOT_KEYS-th of all rows, so HOT_KEYS of them at most, are broadcast; only rows of the others are shuffled.
    """
    hot = F.col("n") > F.lit(max(total // HOT_KEYS, 1))
    added = [c for c in named.columns if c not in (key, "n")]
    tagged = rows.join(F.broadcast(named.where(hot).drop("n").withColumn("_hot", F.lit(True))), key, "left")
    cold = tagged.where("_hot is null").drop("_hot", *added).join(named.where(~hot).drop("n"), key)
    return tagged.where("_hot").drop("_hot").unionByName(cold)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every row of ``docs``."""
    table = common.written(fingerprinted(docs), "fingerprints")
    prints = common.written(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    distinct, total = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(prints, distinct))
    rooted = common.written(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return with_hot_keys(table, rooted.drop("least").join(least, "root").drop("root"), "fp", total).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

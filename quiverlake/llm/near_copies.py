"""Near-copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more, joined into components.

The method is op8's in a wider form: SimHash fingerprints of the whole texts, here of WORDS words and of the distinct five-word shingles, held
as vertical bit planes, compared by carry-save counters with blocks abandoned beyond RADIUS, joined by stars. A pair at 0.8 differs in 0.15
of the bits on average (0.19 in sets of four and five shingles), and is beyond RADIUS with probability below 2 in 10,000 for those and 1 in a million
for others. Choices of agreeing blocks cannot serve as keys at such a radius, so the fingerprints that are compared with each other are those that share
one of BANDS keys of ROWS shingle minima; a pair at 0.8 shares none with probability (1 - 0.8 ** ROWS) ** BANDS, below 3 in 100,000. An exact check
follows: the texts of a component of these links are read again, and all pairs of a component that are not connected yet are compared by
their whole shingle sets, so what stays linked is exact.

A key or component with more texts than a task's share is split into parts, and each pair of parts is a task of its own.

Nulls: null, empty and blank texts have the empty set and are copies of each other. Rows link by their texts, whatever their doc_id: of a
component the row of the smallest doc_id stays, one without doc_id only if none has one, and of rows alike in doc_id and set any one.
Texts shorter than a shingle have one shingle, all their words. Equal sets of shingles are compared once. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bytekit import BASE, Block, mix, windows
from .decontamination import small
from .simhash import components, majority, pair_blocks, stars

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
WORDS, RADIUS = 4, 72
#: Texts of a key, and of a component, that one task compares with each other; rows held at once.
SKETCHES, SETS = 4096, 512
HELD_BYTES = 1 << 24
#: Words of 64 lanes compared at once.
AT_ONCE = 1 << 13

_draws = np.random.default_rng(5)
FLIP = _draws.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
FACTOR = _draws.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
DRAW = _draws.integers(0, 2**63, WORDS, dtype=np.uint64)


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a lower-cased block, in order."""
    start, end = block.words()
    doc = block.document_of(start)
    word = block.span_hash(start, end)
    first, h = windows(block, doc, word, SHINGLE)
    size = np.bincount(doc, minlength=block.n)
    head = np.cumsum(size) - size
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    whole = size[short].astype(np.uint64)
    for i in range(SHINGLE - 1):
        there = size[short] > i
        whole[there] = whole[there] * BASE + word[head[short[there]] + i]
    owner, h = np.concatenate((doc[first], short)), np.concatenate((h, mix(whole)))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[fresh], h[fresh]


def edges_of(owner: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)


def set_hashes(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each document's set of shingles; zero for the empty set."""
    out = np.zeros(n, np.uint64)
    edge = edges_of(owner)
    if len(edge):
        out[owner[edge]] = mix(np.add.reduceat(mix(h ^ BASE), edge))
    return out


def fingerprints(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each document's set of shingles, a row of WORDS words."""
    return np.stack([majority(owner, mix(h ^ d), n) for d in DRAW], axis=1)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, set, print, keys) of every row: the hash of its set, its fingerprint (none of an empty set), and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            block = Block(batch.column("text"), lower=True)
            owner, h = shingles(block)
            edge = edges_of(owner)
            least = np.zeros((len(edge), BANDS * ROWS), np.uint64)
            for i in range(BANDS * ROWS if len(edge) else 0):
                least[:, i] = np.minimum.reduceat((h ^ FLIP[i]) * FACTOR[i], edge)
            key = np.zeros((len(edge), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i in range(ROWS):
                key = key * BASE + least[:, i::ROWS]
            filled = np.zeros(block.n, np.int64)
            filled[owner[edge]] = 1
            prints = fingerprints(owner, h, block.n)
            prints = pa.array([x.tobytes() if f else b"" for x, f in zip(prints, filled.tolist(), strict=True)], pa.binary())
            offsets = pa.array(np.concatenate(([0], np.cumsum(filled * BANDS))), pa.int32())
            keys = pa.ListArray.from_arrays(offsets, pa.array(mix(key).reshape(-1).view(np.int64)))
            found = pa.array(set_hashes(owner, h, block.n).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, prints, keys], ["doc_id", "set", "print", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, set long, print binary, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(set, body) of every row that has words: the sorted hashes of its shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            block = Block(batch.column("text"), lower=True)
            owner, h = shingles(block)
            edge = edges_of(owner)
            found = set_hashes(owner, h, block.n)[owner[edge]].view(np.int64)
            body = [h[a:b].tobytes() for a, b in zip(edge.tolist(), np.append(edge[1:], len(h)).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(body, pa.binary())], ["set", "body"])

    return docs.select("text").mapInArrow(run, "set long, body binary")


def reached(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of ``n`` nodes; ``near(i, others)`` flags the others that are linked to i."""
    left = np.arange(n)
    a, b = [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            flags = near(i, left)
            hit, left = left[flags], left[~flags]
            a.append(np.full(len(hit), i))
            b.append(hit)
            front += hit.tolist()
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))


def alike_prints(body: list[bytes], edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of each group that span all pairs within RADIUS."""
    fp = np.frombuffer(b"".join(body), np.uint64).reshape(len(body), WORDS)
    own = np.arange(len(fp))
    size = np.diff(np.append(edge, len(fp)))
    a = b = np.zeros(0, np.int64)
    for i, j in pair_blocks(fp, own + 1, np.repeat(edge + size, size), RADIUS, AT_ONCE):
        label = stars(own, np.concatenate((a, i)), np.concatenate((b, j)))
        a = np.flatnonzero(label < own)
        b = label[a]
    return a, b


def alike_sets(body: list[bytes], edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the shingle sets of each group that span all pairs of Jaccard similarity SIMILARITY or more."""
    a, b = [], []
    for at, stop in zip(edge.tolist(), np.append(edge[1:], len(body)).tolist(), strict=True):
        sets = [np.frombuffer(x, np.uint64) for x in body[at:stop]]
        size = np.array([len(s) for s in sets])

        def near(i: int, others: np.ndarray, sets: list[np.ndarray] = sets, size: np.ndarray = size) -> np.ndarray:
            out = np.zeros(len(others), bool)
            fits = np.flatnonzero(np.minimum(size[others], size[i]) >= SIMILARITY * np.maximum(size[others], size[i]) - 1e-9)
            if len(fits):
                some = others[fits]
                flat = np.concatenate([sets[k] for k in some])
                place = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                shared = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(size[some]) - size[some])
                out[fits] = shared >= SIMILARITY * (size[some] + size[i] - shared) - 1e-9
            return out

        i, j = reached(len(sets), near)
        a.append(at + i)
        b.append(at + j)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))


def links(members: DataFrame, group: int, alike: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Star links (u, v) between the sets of each key; members: (key, n, set, body), n the members of the key."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, lo, hi, name = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "set"))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        a, b = alike(table.column("body").to_pylist(), np.flatnonzero(new))
        label = stars(name, a, b)
        moved = label < name
        return pa.RecordBatch.from_arrays([pa.array(name[moved]), pa.array(label[moved])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append(batch)
            total += batch.nbytes
            if total < HELD_BYTES:
                continue
            table = pa.Table.from_batches(held)
            key, lo, hi = (table.column(c).to_numpy() for c in ("key", "lo", "hi"))
            other = np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield solve(table.slice(0, cut))
            held, total = table.slice(cut).to_batches(), 0
        if held and sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held))

    parts = F.ceil(F.col("n") / F.lit(group))
    part = F.pmod(F.xxhash64(F.lit(8), "set"), parts)
    tasks = members.select("key", "set", "body", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    tasks = tasks.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "set", "body")
    return tasks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "u long, v long")


def kept(table: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, set) of the row that stays of each component; ``table``: the fingerprints of ``docs``."""
    sets = table.groupBy("set").agg(F.min("doc_id").alias("rep"), F.any_value("print").alias("body"), F.any_value("keys").alias("keys"))
    sets = common.written(sets, "sets")

    keyed = sets.select("set", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key").join(sets.select("set", "body"), "set")
    near = components(links(shared, SKETCHES, alike_prints))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct()
    near = common.written(near.select(F.col("node").alias("set"), F.col("root").alias("key")), "candidates")

    # the texts of the candidates are read again, for their whole sets
    owners = small(sets.join(near, "set", "left_semi").select(F.col("rep").alias("owner")).distinct())
    again = docs.join(owners, docs["doc_id"].cast("long").eqNullSafe(owners["owner"]), "left_semi")
    whole = shingle_sets(again).groupBy("set").agg(F.any_value("body").alias("body"))
    counts = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    roots = components(links(whole.join(near.join(counts, "key"), "set"), SETS, alike_sets))

    named = sets.select("set", "rep").join(roots, F.col("set") == F.col("node"), "left")
    best = F.min(F.struct(F.col("rep").isNull(), "rep", "set")).alias("best")
    return named.groupBy(F.coalesce("root", "set").alias("component")).agg(best).select(F.col("best.rep").alias("doc_id"), "best.set")


def with_sets(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct column ``row``, with its doc_id and the hash of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            block = Block(batch.column("text"), lower=True)
            found = set_hashes(*shingles(block), block.n).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(found)], names=["row", "id", "set"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("id", T.LongType()), T.StructField("set", T.LongType())])
    return rows.mapInArrow(run, schema)


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; all columns as they are.

    A doc_id that one row has decides by itself. The rows of other ids, and those without, are told apart by their sets.
    """
    table = common.written(fingerprinted(docs), "prints")
    chosen = common.written(kept(table, docs), "kept")
    counts = table.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    single = counts.where("n = 1 and doc_id is not null").select("doc_id")
    several = common.written(counts.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("owner")), "repeated-ids")

    # the ids that go are fewer than those that stay, as a rule: they are sent, if few, and the texts that stay are not shuffled
    gone = single.join(chosen, "doc_id", "left_anti").select(F.col("doc_id").alias("gone_id"))
    others = small(common.written(gone.unionByName(several.where("owner is not null").select(F.col("owner").alias("gone_id"))), "gone"))
    alone = docs.where("doc_id is not null").join(others, docs["doc_id"].cast("long") == others["gone_id"], "left_anti")
    owners = small(several)
    rows = with_sets(docs.join(owners, docs["doc_id"].cast("long").eqNullSafe(owners["owner"]), "left_semi"))
    wanted = small(chosen.join(several, chosen["doc_id"].eqNullSafe(several["owner"]), "left_semi").select(F.col("doc_id").alias("kept_id"), F.col("set").alias("kept_set")))
    told = rows.join(wanted, (rows["set"] == wanted["kept_set"]) & rows["id"].eqNullSafe(wanted["kept_id"]), "left_semi")
    return alone.unionByName(told.groupBy("id", "set").agg(F.any_value("row").alias("row")).select("row.*"))

"""Operator 3, LM scoring: a hierarchical Pitman-Yor language model with Chinese-restaurant seating sampled by Gibbs.

Restaurants: one for each previous word (and one for the start of a text), all sharing one parent restaurant of words without context,
whose parent is the uniform distribution over the training words and one unknown word. Customers of a context restaurant are the tokens
seen there; each table sends one customer to the parent. A sweep draws the tables of every dish of every restaurant given all others'
tables of the sweep before (``seating``); after BURN sweeps, SAMPLES seatings are drawn. A sample's predictive probabilities use the
totals of that very seating, so those of each context sum to 1; their average gives a text's score, the sum of base-10 logarithms.

Layout. Documents are cut into chunks. A chunk asks a bucket (by hash) for each of its distinct pairs of context and word once, with
its count, and learns the total and whether it owns the pair: the first chunk that asks seats the pair's customers. So a pair, word or
context that holds a third of all tokens is one entry a chunk, and no restaurant is ever in one task. Words have buckets of their own, to
which chunks send tables by context and by word, and which add them up, seat the parent's customers and answer with totals. A pair
seen once has one table, so only pairs seen more often are drawn. Restaurants grow with the corpus; the driver gets a few sums.
Buckets follow the bytes of the texts. Random numbers are hashes of words, so scores do not depend on partitions. Tables that no later
step reads are removed at once.

Nulls: a null text is empty and has one token, the end. A null doc_id is never held out. Without training text every token has the
probability 1 / 1 (V = 0). Repeated rows count and are scored as often as they occur. A long text is never cut: it makes a long chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytekit import BASE, Block, mix
from .exchange import PACKED, grouped, pack, unpack
from .seating import tables

#: Tokens of a chunk at least; sweeps to burn and seatings to average; the strengths of the parent and the context restaurants.
CHUNK_TOKENS = 1_000_000
BURN, SAMPLES = 1, 3
STRENGTH = (1.0, 1.0)
#: Compression of a chunk's own row, which is sent twice.
LEVEL = 9

#: Fixed 64-bit values for the end of a text, and the context of its first token.
END = np.uint64(0x5E5D0E5D0E5D0E5D)
START = np.uint64(0x7A3B1C9D2E4F6081)

OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
#: Packed rows, and sums of a bucket for the driver.
SUMMED = PACKED + ", sums array<double>"
#: Rows of one chunk that meet in a word's bucket: its words, and the tables of a sweep. Rows of the bucket itself have the key OWN.
KINDS, WORDS, TABLES, OWN = 2, 0, 1, -1


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each document, word hash of every token) of a lower-cased block, each document's end included, in order."""
    start, end = block.words()
    size = np.bincount(block.document_of(start), minlength=block.n) + 1
    word = np.empty(len(start) + block.n, np.uint64)
    is_end = np.zeros(len(word), bool)
    is_end[np.cumsum(size) - 1] = True
    word[is_end] = END
    word[~is_end] = block.span_hash(start, end)
    return size, word


def bucket_ranges(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that occur; a bucket is a range of hashes."""
    if len(sorted_hashes):
        of = ((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(of)], strict=True):
            yield int(of[a]), a, b


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def row(chunk: int, bucket: int, *arrays: np.ndarray, sums: list[float] | None = None, summed: bool = False, level: int = 3) -> pa.RecordBatch:
    """One packed row, with a column for sums if the schema is SUMMED."""
    columns = [pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([pack(*arrays, level=level) if arrays else b""], pa.binary())]
    names = ["chunk", "bucket", "body"]
    if summed:
        columns.append(pa.array([sums], pa.list_(pa.float64())))
        names.append("sums")
    return pa.RecordBatch.from_arrays(columns, names)


class Chunk:
    """A chunk's documents, its distinct words by hash, and its distinct pairs of context and word by hash."""

    def __init__(self, held: np.ndarray, size: np.ndarray, words: np.ndarray, sequence: np.ndarray):
        self.held, self.size, self.words, self.sequence = held, size, words, sequence
        self.start = int(np.searchsorted(words, START))
        first = np.cumsum(size) - size
        before = np.empty(len(sequence), np.int64)
        before[1:] = sequence[:-1]
        before[first] = self.start
        code, entry = np.unique(before * len(words) + sequence, return_inverse=True)
        context, word = np.divmod(code, len(words))
        h = mix(mix(words[context] + BASE) + words[word] * BASE)
        order = np.argsort(h, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.context, self.word, self.pair, self.entry = context[order], word[order], h[order], place[entry]
        self.trained = np.repeat(~held, size)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.entry[self.trained], minlength=len(self.pair))

    def word_counts(self) -> np.ndarray:
        """Training tokens of each word; of the start, training documents."""
        n = np.bincount(self.sequence[self.trained], minlength=len(self.words))
        n[self.start] = (~self.held).sum()
        return n


def packed_chunk(ids: list, held: np.ndarray, size: np.ndarray, word: np.ndarray) -> tuple[Chunk, tuple]:
    words, sequence = np.unique(np.append(word, START), return_inverse=True)
    sequence = sequence[:-1]
    known = np.array([i is not None for i in ids], bool)
    arrays = (np.array([i or 0 for i in ids], np.int64), known, held, size.astype(np.int64), steps(words), sequence.astype(np.uint32))
    return Chunk(held, size, words, sequence), arrays


def unpacked_chunk(body: bytes) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """(chunk, ids, which ids are known)."""
    ids, known, held, size, step, sequence = unpack(body, np.int64, np.bool_, np.bool_, np.int64, np.uint64, np.uint32)
    return Chunk(held, size, np.cumsum(step, dtype=np.uint64), sequence.astype(np.int64)), ids, known


def chunked(docs: DataFrame, held_out: Column, buckets: int) -> DataFrame:
    """Of each chunk its own row (bucket -1), and its pairs with their counts by bucket. A chunk's number is its task's and its place in
    it, so a repeated task makes the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = [i for part in held for i in part[0]]
            chunk, arrays = packed_chunk(ids, *(np.concatenate([part[c] for part in held]) for c in (1, 2, 3)))
            yield row(base + serial, -1, *arrays, level=LEVEL)
            count = chunk.pair_counts()
            for b, lo, hi in bucket_ranges(chunk.pair, buckets):
                yield row(base + serial, b, steps(chunk.pair[lo:hi]), count[lo:hi].astype(np.uint32))

        for batch in common.blocks(batches):
            size, word = tokens(Block(batch.column("text"), lower=True))
            held.append((batch.column("doc_id").to_pylist(), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), size, word))
            total += len(word)
            if total >= CHUNK_TOKENS:
                yield from flush()
                held, total, serial = [], 0, serial + 1
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, PACKED)


def counted(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Answers to a pair's bucket's chunks: the total of each pair, and whether the chunk owns it. The bucket's own row tells the way back to
    all chunks that ask for a pair seen twice or more. Sums: pairs seen once, pairs seen twice."""
    parts = [unpack(body, np.uint64, np.uint32) for _, body in rows]
    sizes = [len(p[0]) for p in parts]
    _, first, inverse = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    owner = np.zeros(len(inverse), bool)
    owner[first] = True
    shared = total[inverse] > 1
    place = np.cumsum(total > 1) - 1
    ends = np.cumsum(sizes)
    for (chunk, _), lo, hi in zip(rows, (ends - sizes).tolist(), ends.tolist(), strict=True):
        yield row(chunk, bucket, total[inverse[lo:hi]], owner[lo:hi], summed=True)
    asked = np.add.reduceat(shared, ends - sizes, dtype=np.int64)
    yield row(OWN, bucket, np.array([c for c, _ in rows], np.int64), asked, place[inverse[shared]].astype(np.uint32), owner[shared], sums=[float((total == 1).sum()), float((total == 2).sum())], summed=True)


def totals_of(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(total, owned) of a chunk's pairs, from the answers in order of their buckets."""
    parts = [unpack(body, np.int64, np.bool_) for _, body in rows]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def placed(buckets: int):
    """Of each chunk: its words with their training tokens and the tables of its owned pairs, one each to begin with, by bucket; and the owned
    pairs seen twice or more (bucket -1), which are drawn later."""

    def run(number: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        chunk = unpacked_chunk(rows[0][1])[0]
        total, owned = totals_of(rows[1:])
        seated = owned & (total > 0)
        width = len(chunk.words)
        n, by_context, by_word = chunk.word_counts(), np.bincount(chunk.context[seated], minlength=width), np.bincount(chunk.word[seated], minlength=width)
        for b, lo, hi in bucket_ranges(chunk.words, buckets):
            yield row(number, b, steps(chunk.words[lo:hi]), *(x[lo:hi].astype(np.uint32) for x in (n, by_context, by_word)))
        k = np.flatnonzero(owned & (total > 1))
        yield row(number, -1, chunk.context[k].astype(np.uint32), chunk.word[k].astype(np.uint32), total[k], steps(chunk.pair[k]), np.ones(len(k), np.int64))

    return run


def added_up(sweep: int, samples: int, state: dict):
    """The word buckets' part of a sweep: adds up the chunks' tables by context and by word, seats the parent's customers, answers.

    Answers hold, for each word of a chunk: training tokens, then for each sample the tables of its restaurant, its customers in the parent
    and their tables. Sums: N, V, words with one and two customers, then by sample the parent's customers and tables.
    """

    def run(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        words = {key // KINDS: unpack(body, np.uint64, np.uint32, np.uint32, np.uint32) for key, body in rows if key >= 0 and key % KINDS == WORDS}
        drawn = {key // KINDS: unpack(body, np.uint32, np.uint32) for key, body in rows if key >= 0 and key % KINDS == TABLES}
        before = [unpack(body, np.int64)[0] for key, body in rows if key == OWN]
        distinct, inverse = np.unique(np.concatenate([np.cumsum(w[0], dtype=np.uint64) for w in words.values()]), return_inverse=True)
        total = lambda parts: np.bincount(inverse, weights=np.concatenate(parts)).astype(np.int64)
        n = total([w[1] for w in words.values()])
        is_word = distinct != START
        answers, parents = [n], []
        for s in range(samples):
            extra = [[d[i].reshape(samples, -1)[s] for d in drawn.values()] if drawn else [np.zeros(len(w[0])) for w in words.values()] for i in (0, 1)]
            of_context, customers = (total([w[2 + i] + e for w, e in zip(words.values(), extra[i], strict=True)]) for i in (0, 1))
            if before:
                rest = state["T"] - before[0].astype(float)
                seated = tables(customers, rest, np.full(len(customers), 1 / (state["V"] + 1)), STRENGTH[0], state["discount"][0], distinct, 64 * sweep + s)
            else:
                seated = (customers > 0).astype(np.int64)
            answers += [of_context, customers, seated]
            parents += [float(customers.sum()), float(seated.sum())]
        at = 0
        for chunk, w in words.items():
            own = inverse[at : at + len(w[0])]
            at += len(own)
            yield row(chunk, bucket, *(a[own] for a in answers), summed=True)
        sums = [float(n[is_word].sum()), float((n[is_word] > 0).sum()), float((answers[2] == 1).sum()), float((answers[2] == 2).sum()), *parents]
        yield row(OWN, bucket, answers[-1], sums=sums, summed=True)

    return run


def word_answers(rows: list[tuple[int, bytes]], samples: int) -> list[np.ndarray]:
    """The arrays of a chunk's words, from the answers in order of their buckets."""
    parts = [unpack(body, *[np.int64] * (1 + 3 * samples)) for _, body in rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def parent_probability(customers: np.ndarray, seated: np.ndarray, state: dict, c: float, t: float) -> np.ndarray:
    """The parent's probability of words; ``c``, ``t``: its customers and tables in all."""
    strength, discount = STRENGTH[0], state["discount"][0]
    return (customers - discount * seated + (strength + discount * t) / (state["V"] + 1)) / (strength + c)


def drawn_tables(sweep: int, samples: int, buckets: int, state: dict):
    """The chunks' part of a sweep: draws the tables of the owned pairs seen twice or more, ``samples`` times. Returns the tables beyond the first
    of each pair by context and by word, to the words' buckets; of the last sweep the sums by pair, at bucket + ``buckets``, else the state."""

    def run(number: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        context, word, c, step, t = unpack(rows[0][1], np.uint32, np.uint32, np.int64, np.uint64, np.int64)
        pair = np.cumsum(step, dtype=np.uint64)
        _, of_context, customers, seated = word_answers(rows[1:], 1)
        base = parent_probability(customers, seated, state, state["C"], state["T"])[word]
        rest = (of_context[context] - t).astype(float)
        draws = [tables(c, rest, base, STRENGTH[1], state["discount"][1], pair, 64 * sweep + s) for s in range(samples)]
        width = len(of_context)
        sums = [np.stack([np.bincount(of, weights=x - 1, minlength=width) for x in draws]).astype(np.uint32) for of in (context, word)]
        at = 0
        for b, body in rows[1:]:
            n = len(unpack(body, *[np.int64] * 4)[0])
            yield row(number, b, *(np.ascontiguousarray(x[:, at : at + n]).reshape(-1) for x in sums))
            at += n
        if samples == 1:
            yield row(number, -1, context, word, c, step, draws[0])
        else:
            total = np.sum(draws, axis=0)
            for b, lo, hi in bucket_ranges(pair, buckets):
                yield row(number, buckets + b, total[lo:hi])

    return run


def sent_back(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """From the bucket's own row and the owners' sums of tables: the sums for each chunk that asks for a pair seen twice or more, in order."""
    chunks, asked, place, owner = unpack(rows[0][1], np.int64, np.int64, np.uint32, np.bool_)
    value = np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64)
    ends = np.cumsum(asked)
    ranges = {c: (hi - n, hi) for c, n, hi in zip(chunks.tolist(), asked.tolist(), ends.tolist(), strict=True)}
    for chunk, body in rows[1:]:
        lo, hi = ranges[chunk]
        value[place[lo:hi][owner[lo:hi]]] = unpack(body, np.int64)[0]
    for chunk, (lo, hi) in ranges.items():
        if hi > lo:
            yield row(chunk, bucket, value[place[lo:hi]])


def finished(buckets: int, state: dict):
    """The scores of a chunk's documents from its own row and the answers on pairs, words and tables, each in its range of buckets."""

    def run(number: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        chunk, ids, known = unpacked_chunk(rows[0][1])
        kinds = [[(b, body) for b, body in rows if k * buckets <= b < (k + 1) * buckets] for k in range(3)]
        c = totals_of(kinds[0])[0]
        n, *samples = word_answers(kinds[1], SAMPLES)
        t = (c > 0).astype(float)
        if kinds[2]:
            t[c > 1] = np.concatenate([unpack(body, np.int64)[0] for _, body in kinds[2]]) / SAMPLES
        p = predictive(chunk.context, chunk.word, c, t, n, samples, state)
        base = np.log10((n + 0.5) / (state["N"] + 0.5 * (state["V"] + 1)))
        at = np.cumsum(chunk.size) - chunk.size
        total = lambda x: np.add.reduceat(x, at)
        yield common.record(
            OUT, doc_id=pa.array(ids, mask=~known), held_out=chunk.held, n_tokens=chunk.size, n_known=total((n[chunk.sequence] > 0).astype(np.int64)),
            train_tokens=np.full(len(ids), int(state["N"])), base_score=total(base[chunk.sequence]), score=total(np.log10(p)[chunk.entry]),
        )

    return run


def predictive(context: np.ndarray, word: np.ndarray, c: np.ndarray, t: np.ndarray, n: np.ndarray, samples: list[np.ndarray], state: dict) -> np.ndarray:
    """The averaged probability of each pair: ``c`` customers, ``t`` tables on average, ``n`` training tokens of each word (a context has as many
    customers), ``samples``: for each the tables of a restaurant, and a word's customers and tables in the parent."""
    strength, discount = STRENGTH[1], state["discount"][1]
    full = strength + n
    back = np.zeros(len(c))
    for s in range(len(samples) // 3):
        of_context, customers, seated = samples[3 * s : 3 * s + 3]
        parent = parent_probability(customers, seated, state, state["samples"][2 * s], state["samples"][2 * s + 1])
        back += ((strength + discount * of_context) / full)[context] * parent[word] / (len(samples) // 3)
    return (c - discount * t) / full[context] + back


def sums_of(table: DataFrame) -> list[float]:
    """The buckets' sums, added up by place."""
    found = table.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x")).collect()
    return [x for _, x in sorted(tuple(r) for r in found)]


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row for each row of ``docs``; learns from the rows not held out."""
    buckets = common.shares(docs)
    state: dict = {}
    share = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    keyed = lambda df, kind: df.withColumn("chunk", F.col("chunk") * KINDS + kind)
    moved = lambda df, k: df.withColumn("bucket", F.col("bucket") + F.lit(k * buckets).cast("int"))
    packed = lambda df: df.select("chunk", "bucket", "body")

    step = lambda df, label: common.settled(common.written(df, label))

    made = common.written(chunked(docs, held_out, buckets).withColumn("asks", F.col("bucket") >= 0), "lm-chunks", by="asks")
    own = packed(made.where("not asks"))
    found = step(grouped(packed(made.where("asks")), "bucket", buckets, counted, SUMMED), "lm-pairs")
    common.dropped(made, "asks=true")
    answers, routes = packed(found.where("chunk >= 0")), packed(found.where(F.col("chunk") == OWN))
    few = sums_of(found)
    seats = step(grouped(own.unionByName(answers), "chunk", buckets, placed(buckets), PACKED), "lm-seats")
    words = keyed(seats.where("bucket >= 0"), WORDS)

    totals = step(grouped(words, "bucket", buckets, added_up(0, 1, state), SUMMED), "lm-words")
    state["N"], state["V"], once, twice, state["C"], state["T"] = sums_of(totals) or [0.0] * 6
    state["discount"] = (share(once, twice), share(*few) if few else 0.5)
    pairs = seats.where("bucket < 0")
    for sweep in range(1, BURN + 2):
        last = sweep > BURN
        samples = SAMPLES if last else 1
        swept = grouped(pairs.unionByName(packed(totals.where("chunk >= 0"))), "chunk", buckets, drawn_tables(sweep, samples, buckets, dict(state)), PACKED)
        tables_ = step(swept, "lm-tables")
        drawn = keyed(tables_.where((F.col("bucket") >= 0) & (F.col("bucket") < buckets)), TABLES)
        before = packed(totals.where(F.col("chunk") == OWN))
        more = step(grouped(words.unionByName(drawn).unionByName(before), "bucket", buckets, added_up(sweep, samples, dict(state)), SUMMED), "lm-words")
        common.dropped(totals)
        totals, pairs = more, tables_.where("bucket < 0")
        sums = sums_of(totals) or [0.0] * (4 + 2 * samples)
        state["C"], state["T"] = sums[4], sums[5]
    state["samples"] = sums[4:]
    common.dropped(seats)
    back = grouped(routes.unionByName(moved(tables_.where(F.col("bucket") >= buckets), -1)), "bucket", buckets, sent_back, PACKED)
    every = own.unionByName(answers).unionByName(moved(packed(totals.where("chunk >= 0")), 1)).unionByName(moved(back, 2))
    return grouped(every, "chunk", buckets, finished(buckets, dict(state)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.fold("doc_id", 5, 1))

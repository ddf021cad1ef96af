"""Operator 7, suffix-array dedup: removes every byte covered by a LENGTH-byte string that also starts elsewhere.

A sparse suffix array by a distributed merge sort. The suffixes are those at anchors: in every LENGTH-byte string the leftmost smallest
hash of its GRAM-byte strings is an anchor, so equal strings have anchors at equal offsets and none is missed. Anchors whose GRAM bytes
occur at one place only are left out first. A chunk of documents sorts its anchors' contexts (LENGTH bytes to the right, then those
that a string around the anchor may have to the left), front-codes each sorted run and sends it to the bucket of the anchor's
GRAM bytes. A bucket merges its runs with a loser tree whose nodes keep the common prefix with the last suffix put out, so that known
prefixes are never compared again. From the merged order's common prefixes (to the right) and those of the sorted left contexts follows,
for every offset of the string around the anchor, whether it occurs elsewhere; the answers go back to the chunks, which cut the bytes.

Equal contexts are one record a chunk, with their number. An anchor whose GRAM bytes are in more than HOT records all over would still
make one large bucket, as its contexts differ outside the shared passage: the strings around such anchors are counted by their hashes,
spread over all buckets. This is the exact way for hot groups, not a cut; both ways give the same result but for collisions of 64-bit
hashes. The number of buckets follows the bytes of the texts, so a task's share does not grow with the input.

Nulls: a null text is empty. Texts under LENGTH bytes keep everything. Repeated rows are two documents with the same text: both lose
all bytes if long enough. Texts need not be unique by doc_id, and a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytekit import BASE, Block, mix
from .exchange import PACKED, grouped, pack, packed_row, unpack

LENGTH = 200
GRAM = 32
#: Starts of GRAM-byte strings inside a string of LENGTH bytes; the left context an anchor can need.
PLACES = LENGTH - GRAM + 1
LEFT = PLACES - 1
KEY = LENGTH + LEFT + 2
#: Text bytes of a chunk, and records of one anchor content beyond which its strings are counted instead of merged.
CHUNK_BYTES = 2 << 20
HOT = 5000

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_BODY = (np.int64, np.bool_, np.int64, np.int64, np.uint8, np.uint32)
#: Compression of what is sent: texts and contexts are most of the bytes.
LEVEL = 6


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of its GRAM bytes) of the anchors of a block."""
    n = len(block.data)
    if n < LENGTH or not (block.sizes >= LENGTH).any():
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    position = np.arange(n - GRAM + 1)
    h = block.quick_hash(position, position + GRAM)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | position.astype(np.uint64)
    width = 1
    while 2 * width <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[PLACES - width : PLACES - width + n - LENGTH + 1])
    valid = np.zeros(n + 1, np.int64)
    long = block.sizes >= LENGTH
    np.add.at(valid, block.starts[long], 1)
    np.add.at(valid, block.ends[long] - LENGTH + 1, -1)
    chosen = np.unique((low[np.cumsum(valid)[: n - LENGTH + 1] > 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return chosen, block.span_hash(chosen.astype(np.int64), chosen.astype(np.int64) + GRAM)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in order) for the buckets that occur."""
    if not len(hashes):
        return
    bucket = (mix(hashes ^ BASE) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
    for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def chunked(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows of all chunks: their texts and anchors, and the distinct anchor hashes by bucket with the number of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for serial, batch in enumerate(common.blocks(batches, most=CHUNK_BYTES)):
            block, ids = Block(batch.column("text")), batch.column("doc_id").to_pylist()
            position, h = anchors(block)
            body = pack(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids]), block.starts, block.ends, block.data, position, level=LEVEL)
            yield packed_row(base + serial, -1, body)
            distinct, count = np.unique(h, return_counts=True)
            for b, at in by_bucket(distinct, buckets):
                yield packed_row(base + serial, b, pack(distinct[at], count[at].astype(np.uint32)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


def counted(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """For each hash a chunk asks for: 0 it occurs once in all, 1 more often, 2 in more than HOT."""
    parts = [unpack(body, np.uint64, np.uint32) for _, body in rows]
    _, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]))
    answer = ((total > 1).astype(np.uint8) + (total > HOT))[inverse]
    at = 0
    for (chunk, _), p in zip(rows, parts, strict=True):
        yield packed_row(chunk, bucket, pack(answer[at : at + len(p[0])].astype(np.uint8)))
        at += len(p[0])


def spread(answers: list[tuple[int, np.ndarray]], hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Answers by bucket, put in the order of ``hashes`` (the distinct hashes a chunk asked for)."""
    found = dict(answers)
    out = np.zeros(len(hashes), np.uint8)
    for b, at in by_bucket(hashes, buckets):
        out[at] = found[b]
    return out


def contexts(data: np.ndarray, start: np.ndarray, end: np.ndarray, position: np.ndarray) -> np.ndarray:
    """(anchors, KEY) bytes: the right context, the left one backwards, both padded by zeros, and their two lengths."""
    right = position[:, None] + np.arange(LENGTH)[None, :]
    left = position[:, None] - 1 - np.arange(LEFT)[None, :]
    out = np.zeros((len(position), KEY), np.uint8)
    out[:, :LENGTH] = np.where(right < end[:, None], data[np.minimum(right, len(data) - 1)], 0)
    out[:, LENGTH : LENGTH + LEFT] = np.where(left >= start[:, None], data[np.maximum(left, 0)], 0)
    out[:, -2] = np.minimum(end - position, LENGTH)
    out[:, -1] = np.minimum(position - start, LEFT)
    return out


def front_coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts keys: (record of each key, number of each record, common prefix of each record with the one before, bytes beyond it)."""
    raw = keys.tobytes()
    rows = [raw[i : i + KEY] for i in range(0, len(raw), KEY)]
    order = np.array(sorted(range(len(rows)), key=rows.__getitem__), np.int64)
    m = keys[order]
    unlike = m[1:] != m[:-1]
    new = np.concatenate(([True], unlike.any(axis=1)))
    record = np.empty(len(order), np.int64)
    record[order] = np.cumsum(new) - 1
    prefix = np.concatenate(([0], unlike.argmax(axis=1)))[new].astype(np.uint16)
    m = m[new]
    return record, np.bincount(record).astype(np.uint32), prefix, m[np.arange(KEY)[None, :] >= prefix[:, None]]


def string_starts(position: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of the LENGTH-byte strings around the given anchors, each once."""
    lo, hi = np.maximum(position - LEFT, start), np.minimum(position, end - LENGTH)
    size = np.maximum(hi - lo + 1, 0)
    return np.unique(np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))


class Chunk:
    """A chunk's own row, and what follows from the answers on its anchors; the same in every stage that needs it."""

    def __init__(self, body: bytes, answers: list[tuple[int, np.ndarray]], buckets: int):
        self.ids, self.known, self.starts, self.ends, self.data, position = unpack(body, *_BODY)
        position = position.astype(np.int64)
        self.block = Block(pa.array([], pa.string()))
        self.block.data = self.data
        h = self.block.span_hash(position, position + GRAM)
        distinct, inverse = np.unique(h, return_inverse=True)
        state = spread(answers, distinct, buckets)[inverse]
        doc = np.searchsorted(self.ends, position, side="left")
        start, end = self.starts[doc], self.ends[doc]
        merged, hot = state == 1, state == 2
        self.position, self.hash, self.start, self.end = position[merged], h[merged], start[merged], end[merged]
        self.strings = string_starts(position[hot], start[hot], end[hot])

    def string_hashes(self) -> np.ndarray:
        return self.block.span_hash(self.strings, self.strings + LENGTH)


def split_rows(rows: list[tuple[int, bytes]], low: int, high: int) -> list[tuple[int, bytes]]:
    return [(b - low, body) for b, body in rows if low <= b < high]


def runs(rows: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk: front-coded runs by bucket, and the hashes of hot strings by bucket, these at bucket + ``buckets``."""

    def build(number: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(rows[0][1], [(b, unpack(body, np.uint8)[0]) for b, body in rows[1:]], buckets)
        for b, at in by_bucket(chunk.hash, buckets):
            _, count, prefix, rest = front_coded(contexts(chunk.data, chunk.start[at], chunk.end[at], chunk.position[at]))
            yield packed_row(number, b, pack(count, prefix, rest, level=LEVEL))
        distinct, count = np.unique(chunk.string_hashes(), return_counts=True)
        for b, at in by_bucket(distinct, buckets):
            yield packed_row(number, buckets + b, pack(distinct[at], count[at].astype(np.uint32)))

    return grouped(rows, "chunk", buckets, build, PACKED)


def decoded(prefix: np.ndarray, rest: np.ndarray) -> list[bytes]:
    raw, at, last, out = rest.tobytes(), 0, b"", []
    for p in prefix.tolist():
        last = last[:p] + raw[at : at + KEY - p]
        at += KEY - p
        out.append(last)
    return out


def merge(runs_: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs of (keys, common prefix of each key with the one before): (run, index, common prefix with the last one put out).

    A loser tree. Every node keeps the loser and its common prefix with the winner that passed; on the winner's path that is the last
    key put out, as it is for the winner's successor. Of two keys the one with the longer prefix is smaller; only equal prefixes
    are compared, and only beyond what both share. A run that ended has the prefix -1.
    """
    size = 1
    while size < len(runs_):
        size *= 2
    keys = [r[0] for r in runs_] + [[]] * (size - len(runs_))
    prefixes = [r[1] for r in runs_] + [[]] * (size - len(runs_))
    index = [0] * size
    loser, common_ = [0] * size, [-1] * size

    def beats(i: int, p: int, j: int, q: int) -> tuple[bool, int]:
        """Whether run i's head goes before run j's, and the common prefix of the loser with the winner."""
        if p != q:
            return p > q, min(p, q)
        if p < 0:
            return True, -1
        x, y = keys[i][index[i]], keys[j][index[j]]
        if x == y:
            return i < j, KEY
        n = KEY - p
        bits = int.from_bytes(x[p:], "big") ^ int.from_bytes(y[p:], "big")
        return x < y, p + (8 * n - bits.bit_length()) // 8

    winner = [0] * size + list(range(size))
    prefix = [0] * size + [0 if k else -1 for k in keys]
    for node in range(size - 1, 0, -1):
        a, b = 2 * node, 2 * node + 1
        first, shared = beats(winner[a], prefix[a], winner[b], prefix[b])
        won, lost = (a, b) if first else (b, a)
        winner[node], prefix[node] = winner[won], prefix[won]
        loser[node], common_[node] = winner[lost], shared if prefix[lost] >= 0 else -1
    now, p = (winner[1], prefix[1]) if size > 1 else (0, 0 if keys[0] else -1)
    while p >= 0:
        yield now, index[now], p
        index[now] += 1
        p = prefixes[now][index[now]] if index[now] < len(keys[now]) else -1
        node = (size + now) // 2
        while node:
            q = common_[node]
            if q > p:
                loser[node], now, common_[node], p = now, loser[node], p, q
            elif q == p and p >= 0:
                first, shared = beats(now, p, loser[node], q)
                common_[node] = shared
                if not first:
                    loser[node], now = now, loser[node]
            node //= 2


def extents(keys: np.ndarray, shared: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct records: the largest and smallest left part of a string around the anchor that occurs elsewhere too.

    ``shared``: common prefix of each record with the one before, ``number``: how often it occurs. (0, 255) where no string does.
    """
    n = len(keys)
    most, least = np.zeros(n, np.uint8), np.full(n, 255, np.uint8)
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    # the left contexts in order, with the common prefix of each with the one before: equal ones are neighbours
    context = np.ascontiguousarray(keys[:, LENGTH : LENGTH + LEFT])
    order = np.argsort(context.view(f"V{LEFT}").reshape(-1), kind="stable") if n else np.zeros(0, np.int64)
    unlike = context[order][1:] != context[order][:-1]
    same = np.concatenate(([0], np.where(unlike.any(axis=1), unlike.argmax(axis=1), LEFT)))[:n]
    before = np.empty(n, np.int64)
    for j in range(LEFT + 1):
        fits = (left >= j) & (right >= LENGTH - j)
        if not fits.any():
            continue
        before[order] = np.cumsum(same < j)
        pair = np.cumsum(shared < LENGTH - j) * (n + 1) + before
        _, inverse = np.unique(pair[fits], return_inverse=True)
        again = np.zeros(n, bool)
        again[fits] = np.bincount(inverse, weights=number[fits])[inverse] > 1
        most[again] = j
        least[again & (least == 255)] = j
    return most, least


def merged(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of a bucket and answers each with the extents of its records."""
    parts = [unpack(body, np.uint32, np.uint16, np.uint8) for _, body in rows]
    sorted_runs = [(decoded(prefix, rest), prefix.tolist()) for _, prefix, rest in parts]
    record = [np.empty(len(p[0]), np.int64) for p in parts]
    number, keys, shared = [], [], []
    for run, i, p in merge(sorted_runs):
        if p < KEY:
            keys.append(sorted_runs[run][0][i])
            shared.append(p)
            number.append(0)
        number[-1] += int(parts[run][0][i])
        record[run][i] = len(keys) - 1
    most, least = extents(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY), np.array(shared), np.array(number, float))
    for (chunk, _), at in zip(rows, record, strict=True):
        yield packed_row(chunk, bucket, pack(most[at], least[at]))


def finished(rows: list[tuple[int, bytes]], buckets: int) -> pa.RecordBatch:
    """The result rows of a chunk from its own row and the answers of the three lookups, each in its range of buckets."""
    own = [body for b, body in rows if b == -1][0]
    chunk = Chunk(own, [(b, unpack(body, np.uint8)[0]) for b, body in split_rows(rows, 0, buckets)], buckets)
    edge = np.zeros(len(chunk.data) + 1, np.int64)
    answers = dict(split_rows(rows, buckets, 2 * buckets))
    for b, at in by_bucket(chunk.hash, buckets):
        record = front_coded(contexts(chunk.data, chunk.start[at], chunk.end[at], chunk.position[at]))[0]
        most, least = (x[record].astype(np.int64) for x in unpack(answers[b], np.uint8, np.uint8))
        hit = least < 255
        np.add.at(edge, chunk.position[at][hit] - most[hit], 1)
        np.add.at(edge, chunk.position[at][hit] + LENGTH - least[hit], -1)
    distinct, inverse = np.unique(chunk.string_hashes(), return_inverse=True)
    often = spread([(b, unpack(body, np.uint8)[0]) for b, body in split_rows(rows, 2 * buckets, 3 * buckets)], distinct, buckets)[inverse] > 0
    np.add.at(edge, chunk.strings[often], 1)
    np.add.at(edge, chunk.strings[often] + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(gone)))
    begins = np.concatenate(([0], np.cumsum(gone & ~np.concatenate(([False], gone[:-1])))))
    kept = chunk.data[~gone]
    place = np.concatenate(([0], np.cumsum(~gone)))
    text = kept.tobytes()
    digest = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(place[chunk.starts].tolist(), place[chunk.ends].tolist(), strict=True)]
    return common.record(
        OUT, doc_id=pa.array(chunk.ids, mask=~chunk.known), n_bytes=chunk.ends - chunk.starts, n_removed=total[chunk.ends] - total[chunk.starts],
        n_spans=begins[chunk.ends] - begins[chunk.starts], kept_sha256=digest,
    )


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``."""
    buckets = common.shares(docs)
    table = common.written(chunked(docs, buckets), "suffix-chunks")
    own = table.where("bucket < 0")
    answers = common.written(grouped(table.where("bucket >= 0"), "bucket", buckets, counted, PACKED), "suffix-anchors")
    sent = common.written(runs(own.unionByName(answers), buckets), "suffix-runs")
    extent = grouped(sent.where(F.col("bucket") < buckets), "bucket", buckets, merged, PACKED)
    strings = grouped(sent.where(F.col("bucket") >= buckets), "bucket", buckets, counted, PACKED)
    moved = extent.withColumn("bucket", F.col("bucket") + buckets).unionByName(strings.withColumn("bucket", F.col("bucket") + buckets))
    back = own.unionByName(answers).unionByName(moved)
    return grouped(back, "chunk", buckets, lambda _, rows: iter([finished(rows, buckets)]), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))

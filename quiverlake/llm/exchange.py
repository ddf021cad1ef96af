"""Lookups by shuffle: chunks of documents ask buckets of keys and get answers back, in rows that pack columns as bytes.

A chunk holds some megabytes of text and asks for each distinct key once, so a key that holds a third of all rows is one entry a chunk.
A bucket holds the entries of its share of all keys. Rows are (chunk, bucket, body); bucket -1 holds what a chunk keeps for itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

PACKED = "chunk long, bucket int, body binary"


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays one after the other, behind their lengths in bytes, each in byte planes (first bytes of all items, then second ones), compressed."""
    parts = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))


def unpack(body: bytes, *types) -> list[np.ndarray]:
    """The arrays of a packed body, read as ``types``."""
    body = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 8 * len(types)
    for kind, n in zip(types, np.frombuffer(body, np.int64, len(types)).tolist(), strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(body, np.uint8, n, at).reshape(width, n // width)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n
    return out


def packed_row(chunk: int, bucket: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], ["chunk", "bucket", "body"])


def grouped(rows: DataFrame, by: str, parts: int, run: Callable[[int, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs ``run(group, [(other key, body), ...])`` on each group of packed rows; ``by`` is bucket or chunk, the rows are in order of the other."""
    other = "chunk" if by == "bucket" else "bucket"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:
            for group, key, body in zip(*(batch.column(c).to_pylist() for c in (by, other, "body")), strict=True):
                if held and group != now:
                    yield from run(now, held)
                    held = []
                now = group
                held.append((key, body))
        if held:
            yield from run(now, held)

    return rows.repartition(parts, by).sortWithinPartitions(by, other).mapInArrow(each, schema)

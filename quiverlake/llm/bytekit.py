"""Numpy kernels over blocks of UTF-8 texts: words, lines and windows as byte ranges with 64-bit content hashes.

A block is one byte buffer in which every document is followed by one line feed, so no word or window hash can span documents.
Hashes are two polynomials over random byte values, one modulo 2**64 and one modulo the prime 2**31 - 1, mixed into 64 bits: contents
built to collide in the first (Thue-Morse words do, whatever the base) differ in the second. Equal hashes are taken as equal contents.
A block's arrays take up to 50 bytes a text byte, so the longest single text bounds a worker's memory: 10 MB of text need 0.5 GB.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
PRIME = np.uint64((1 << 31) - 1)
BASE31 = 0x2C1B3C6D
VALUE31 = np.random.default_rng(20240608).integers(1, 2**31 - 1, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold31(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for any x below 2**63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


@lru_cache(maxsize=2)
def _powers31(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE31 and of its inverse modulo 2**31 - 1, by doubling."""
    out = []
    for base in (BASE31, pow(BASE31, -1, int(PRIME))):
        x = np.ones(1 << bits, np.uint64)
        for k in range(bits):
            x[1 << k : 2 << k] = fold31(x[: 1 << k] * np.uint64(pow(base, 1 << k, int(PRIME))))
        out.append(x.astype(np.uint32))
    return out[0], out[1]


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    return up, down


class Block:
    """Texts of some documents in one buffer. ``starts``/``ends``: each document's byte range in ``data``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.n = n
        self.starts = offsets[:-1] + np.arange(n)
        self.ends = offsets[1:] + np.arange(n)
        data = np.full(len(raw) + n, 10, np.uint8)
        body = np.ones(len(data), bool)
        body[self.ends] = False
        data[body] = LOWER[raw] if lower else raw
        self.data = data
        self.sizes = self.ends - self.starts
        self._prefix: np.ndarray | None = None
        self._prefix31: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[self.data] * self._up()[0][: len(self.data)], out=self._prefix[1:])
        return self._prefix

    @property
    def prefix31(self) -> np.ndarray:
        if self._prefix31 is None:
            self._prefix31 = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(fold31(VALUE31[self.data] * _powers31(self._bits())[0][: len(self.data)]), out=self._prefix31[1:])
        return self._prefix31

    def _bits(self) -> int:
        return max(20, int(len(self.data)).bit_length())

    def _up(self) -> tuple[np.ndarray, np.ndarray]:
        return _powers(self._bits())

    def quick_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes in each [start, end), for choices that need no protection against contents built to collide."""
        h = (self.prefix[end] - self.prefix[start]) * self._up()[1][start]
        return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes in each [start, end)."""
        other = fold31(fold31(self.prefix31[end] - self.prefix31[start]) * _powers31(self._bits())[1][start])
        return mix(self.quick_hash(start, end) + other * BASE)

    def document_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="left")

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each maximal run of bytes that are no ASCII white space."""
        inside = ~IS_SPACE[self.data]
        before = np.concatenate(([False], inside[:-1]))
        return np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one a byte) in each document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.ends] - total[self.starts]


def windows(block: Block, doc: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``width`` words inside one document."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[:n] == doc[width - 1 :])
    h = np.zeros(len(first), np.uint64)
    for i in range(width):
        h = h * BASE + hashes[first + i]
    return first, mix(h)


def repeated(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the same (owner, hash) occurs twice or more."""
    key = mix(hashes + owner.astype(np.uint64) * BASE)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def covered(n: int, first: np.ndarray, width: int) -> np.ndarray:
    """Flags of the positions in the union of [first, first + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + width, n), -1)
    return np.cumsum(edge[:n]) > 0

"""Operator 6, SentencePiece encoding and decoding: sampled segmentations by forward filtering and backward sampling, lossless decoding.

The pieces come from a public SentencePiece model, which is read, never trained. Its scores are merge ranks, so a piece's probability is
taken from Zipf's law, 1 / (rank + SHIFT), to the power ``sharpness``. A text is cut between any two characters that are neighbours in no
piece; no piece can cross such a cut, so the lattice of a text is a chain of small ones. For all distinct units of a block at once, forward filtering sums the
weights of all segmentations of each prefix, in logarithms; then a segmentation of every unit of every text is drawn backwards, with
uniform numbers of a counter-based generator keyed by seed, row key, the unit's place and the step. So a row's segmentation depends on
its key and text only, not on partitions, blocks or order.

Lossless: blanks are the marker sign; a character without a piece, and a marker sign in the text itself, become byte pieces. Decoding
joins the bytes of the pieces, and gives the text back exactly.

Nulls: a null text has null pieces and counts as lossless; an empty one has none. A null key is drawn as key 0. Repeated rows get the same pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytekit import BASE, mix

#: The model is a parameter; this is where the public tokenizers lie.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 6
SHARPNESS = 1.0
SHIFT = 10.0
MARK = "▁"
#: Weight (logarithm) of a character that only byte pieces can write.
BYTES_WEIGHT = -7.0
#: Text bytes of a block: all arrays of the filtering are some multiples of it.
BLOCK_BYTES = 1 << 19
#: Code points with a row and column in the table of neighbours; beyond it, neighbours are looked up in a sorted list.
TABLE = 1024

OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("pieces", pa.list_(pa.int32())), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    """The pieces of a model, with weights; encodes and decodes."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.surface: list[bytes] = []
        self.weight: dict[str, tuple[float, int]] = {}
        self.byte = np.full(256, -1, np.int32)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.surface.append(b"")
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.surface[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain = piece.replace(MARK, " ")
                self.surface[i] = plain.encode()
                self.weight[plain] = (-sharpness * float(np.log(max(0.0, -sp.get_score(i)) + SHIFT)), i)
        if (self.byte < 0).any():
            raise ValueError("the model lacks byte pieces")
        sizes = np.array([len(x) for x in self.surface])
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.size, self.at = sizes, np.cumsum(sizes) - sizes
        self.longest = max(map(len, self.weight))
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            rows = sorted((int(self._horner(_points(w), n)[0]), *v) for w, v in self.weight.items() if len(w) == n)
            self.tables.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], np.int32)))
        near = {w[i : i + 2] for w in self.weight for i in range(len(w) - 1)}
        self.near = np.zeros((TABLE, TABLE), bool)
        for x, y in (map(ord, w) for w in near):
            if x < TABLE and y < TABLE:
                self.near[x, y] = True
        self.far = np.array(sorted(ord(w[0]) << 32 | ord(w[1]) for w in near if max(map(ord, w)) >= TABLE), np.uint64)

    @staticmethod
    def _horner(c: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all runs of ``n`` code points; ``before``: those of n - 1."""
        if before is None:
            h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
            for i in range(n):
                h = h * BASE + c[i : len(c) - n + 1 + i] + np.uint64(1)
            return h
        return before[: len(c) - n + 1] * BASE + c[n - 1 :] + np.uint64(1)

    def cuts(self, c: np.ndarray) -> np.ndarray:
        """True at each position whose character is a neighbour of the one before in no piece."""
        if len(c) < 2:
            return np.ones(len(c), bool)
        x, y = c[:-1], c[1:]
        joined = self.near[np.minimum(x, TABLE - 1), np.minimum(y, TABLE - 1)]
        wide = np.flatnonzero((x >= TABLE - 1) | (y >= TABLE - 1))
        if len(wide):
            key = x[wide].astype(np.uint64) << np.uint64(32) | y[wide]
            small = (x[wide] < TABLE) & (y[wide] < TABLE)
            found = np.isin(key, self.far)
            joined[wide] = np.where(small, self.near[np.minimum(x[wide], TABLE - 1), np.minimum(y[wide], TABLE - 1)], found)
        return np.concatenate(([True], ~joined))

    def filtered(self, c: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering of units laid out in ``c``: (log sums at each end, log weights and ids of the edge of each length that ends there).

        Position start + unit number + k of the first array is the end after k characters; edges are (length - 1, that position).
        """
        n = len(c)
        unit = np.repeat(np.arange(len(size)), size)
        left = start[unit] + size[unit] - np.arange(n)
        places = n + len(size)
        weight = np.full((self.longest, places), -np.inf)
        ids = np.full((self.longest, places), -1, np.int32)
        h = None
        for length in range(1, self.longest + 1):
            if n < length:
                break
            h = self._horner(c, length, h)
            at = np.flatnonzero(left[: len(h)] >= length)
            keys, w, i = self.tables[length - 1]
            if length > 1 and not len(at):
                break
            if len(keys):
                where = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                hit = keys[where] == h[at]
                end = at[hit] + unit[at[hit]] + length
                weight[length - 1, end], ids[length - 1, end] = w[where[hit]], i[where[hit]]
        end = np.arange(n) + unit + 1
        only = end[ids[0, end] < 0]  # characters that only bytes can write
        weight[0, only] = BYTES_WEIGHT
        first = start + np.arange(len(size))
        total = np.full(places, -np.inf)
        total[first] = 0.0
        going = np.argsort(-size, kind="stable")
        sorted_size = -np.sort(-size)
        for k in range(1, int(size.max(initial=0)) + 1):
            alive = int(np.searchsorted(-sorted_size, -k, side="right"))
            place = first[going[:alive]] + k
            terms = np.array([total[place - length] + weight[length - 1, place] for length in range(1, min(k, self.longest) + 1)])
            top = terms.max(axis=0)
            total[place] = top + np.log(np.exp(terms - top).sum(axis=0))
        return total, weight, ids

    def drawn(self, end: np.ndarray, size: np.ndarray, key: np.ndarray, total: np.ndarray, weight: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward sampling of units that end at places ``end``: (unit, start inside it, piece id or -1 for bytes) of every piece, unordered."""
        at, rest, who = end.copy(), size.astype(np.int64).copy(), np.arange(len(end))
        out = []
        step = 0
        while len(who):
            u = (mix(key[who] + np.uint64((step + 1) * int(BASE) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            chosen = np.zeros(len(who), np.int64)
            low = np.zeros(len(who))
            open_ = np.ones(len(who), bool)
            last = np.zeros(len(who), np.int64)
            for length in range(1, self.longest + 1):
                fits = open_ & (rest >= length)
                if not fits.any():
                    break
                j = np.flatnonzero(fits)
                share = np.exp(total[at[j] - length] + weight[length - 1, at[j]] - total[at[j]])
                some = share > 0
                low[j] += share
                last[j[some]] = length
                hit = some & (u[j] < low[j])
                chosen[j[hit]] = length
                open_[j[hit]] = False
            chosen = np.where(chosen > 0, chosen, last)  # rounding may leave the sum of the shares just under 1
            out.append((who, rest - chosen, ids[chosen - 1, at]))
            at, rest = at - chosen, rest - chosen
            left = rest > 0
            at, rest, who = at[left], rest[left], who[left]
            step += 1
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def encode_all(self, texts: list[str], keys: list[int], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts one after the other, number of each text)."""
        points = [_points(t) for t in texts]
        length = np.array([len(x) for x in points], np.int64)
        c = np.concatenate(points) if points else np.zeros(0, np.uint32)
        n = np.zeros(len(texts), np.int64)
        if not len(c):
            return np.zeros(0, np.int32), n
        begin = np.cumsum(length) - length
        cut = self.cuts(c)
        cut[begin[length > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(c)))
        doc = np.searchsorted(np.cumsum(length), start, side="right")
        hashes = self._unit_hashes(c, start, size)
        _, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        usize = size[first]
        ustart = np.cumsum(usize) - usize
        uc = c[np.repeat(start[first] - ustart, usize) + np.arange(usize.sum())]
        total, weight, ids = self.filtered(uc, ustart, usize)
        place = np.arange(len(start)) - np.searchsorted(doc, doc)
        row = mix(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) ^ mix(np.full(1, seed, np.uint64)))
        key = mix(row[doc] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        who, inside, piece = self.drawn((ustart + np.arange(len(usize)) + usize)[unit], size, key, total, weight, ids)
        order = np.argsort(start[who] + inside)
        who, at, piece = who[order], (start[who] + inside)[order], piece[order]
        raw = np.flatnonzero(piece < 0)
        count = np.ones(len(piece), np.int64)
        spelled = [self.byte[np.frombuffer(chr(int(x)).encode(), np.uint8)] for x in c[at[raw]]]
        count[raw] = [len(x) for x in spelled]
        out = np.repeat(piece, count)
        out[out < 0] = np.concatenate(spelled) if spelled else []
        return out, np.bincount(doc[who], weights=count, minlength=len(texts)).astype(np.int64)

    @staticmethod
    def _unit_hashes(c: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each unit's code points: sums of mixed (character, place) pairs, mixed with the size."""
        place = np.arange(len(c)) - np.repeat(start, size)
        h = np.add.reduceat(mix(c.astype(np.uint64) * BASE + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), start)
        return mix(h + size.astype(np.uint64))

    def encode(self, text: str, key: int, seed: int = SEED) -> list[int]:
        return self.encode_all([text], [key], seed)[0].tolist()

    def written(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces one after the other, number of each piece)."""
        n = self.size[ids]
        return self.bytes[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def decode(self, ids: list[int]) -> str:
        return self.written(np.array(ids, np.int64))[0].tobytes().decode()


def load(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_made: dict[tuple[int, float], Pieces] = {}


def shared(model: bytes, sharpness: float) -> Pieces:
    """One Pieces object a worker."""
    key = (hash(model), sharpness)
    if key not in _made:
        _made[key] = Pieces(model, sharpness)
    return _made[key]


def encode(docs: DataFrame, model: bytes | None = None, seed: int = SEED, sharpness: float = SHARPNESS, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_pieces, pieces, decoded_sha256 and lossless of every row of ``docs``; ``most``: text bytes of a block, which change no result."""
    shipped = docs.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(shipped.value, sharpness)
        for batch in common.blocks(batches, most=most):
            none = batch.column("text").is_null()
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            ids, sizes = pieces.encode_all(texts, [k or 0 for k in batch.column("doc_id").to_pylist()], seed)
            raw, n = pieces.written(ids)
            place = np.concatenate(([0], np.cumsum(n)))
            edge = np.concatenate(([0], np.cumsum(sizes)))
            body, ends = raw.tobytes(), place[edge].tolist()
            back = [body[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=none)
            digest = [hashlib.sha256(x).hexdigest() for x in back]
            same = [x == t.encode() for x, t in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), lists, pa.array(digest, pa.string()), pa.array(same, pa.bool_())], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>, decoded_sha256 string, lossless boolean")


def decode(encoded: DataFrame, model: bytes | None = None, sharpness: float = SHARPNESS) -> DataFrame:
    """(doc_id, text) from (doc_id, pieces): the inverse of ``encode``."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(shipped.value, sharpness)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))

"""Operator 10, personal data: candidate spans from high-recall generators, boosted trees over format and context, calibrated thresholds.

Base spans (e-mail addresses, IPv4 addresses, payment cards, phone numbers) follow fixed patterns and checks and always stay. The
generators propose more, overlapping spans: digit groups in any grouping, addresses in disguise, long tokens, and values assigned to
words such as ``password``.

Gradient-boosted trees learn from a bounded sample what such spans look like without the marks that give them away. Positive examples are
base spans written in disguise (no plus sign, ``(at)`` and ``dot``, ``[.]``) and values behind a naming word, half of them with that word
taken away (a plain word behind a colon is prose, and none); negative ones are candidates that fail their kind's check, lie inside
another kind's span, or are tokens without a name. What a
label rests on is thus no feature: the check digit of cards and the range of address parts are never features, and the rest is hidden.
Candidates that neither rule settles are not learned from. Every fifth example calibrates the trees' probabilities, and the least one at
which a kind reaches PRECISION there is its threshold. Accepted candidates that overlap no better span are added.

Nulls: a null text is an empty one (no spans). Offsets count code points, the end is exclusive. Repeated rows stay and are learned from
once. Long texts are searched whole; a table without spans gives trees that accept nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract: the base patterns, and the order of kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_AT, _DOT = r"(?:@|[ ]?\(at\)[ ]?|[ ]?\[at\][ ]?|[ ]at[ ])", r"(?:\.|[ ]?\(dot\)[ ]?|[ ]?\[dot\][ ]?|\[\.\]|[ ]dot[ ])"
_NAME = r"(?:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|pwd)"
#: High-recall generators of further candidates by kind, searched around marks: digits, signs of addresses.
GENERATORS = (
    ("email", re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,24}}){{1,4}}")),
    ("ip", re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\+?(?:[0-9]{1,3}[\x20./-]?)?\(?[0-9]{1,4}\)?[\x20./-]{0,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])")),
)
_MARK = re.compile(r"[0-9]|@|\(at\)|\[at\]|[ ]at[ ][A-Za-z0-9-]{1,63}(?=[ ]dot[ ])")
#: Characters around a mark within which the patterns above lie.
AROUND = 280
#: Generators of secrets, searched in the whole text: long tokens of letters and digits, and any value behind a naming word and = or :.
TOKEN = re.compile(r"[A-Za-z0-9_/+-]{12,}={0,2}")
NAMED_VALUE = re.compile(rf"(?i)(?<![a-z]){_NAME}[\"']?[ ]{{0,3}}(?:=>|[=:])[ ]{{0,3}}(?:\"([^\"\s]{{4,}})\"|'([^'\s]{{4,}})'|([^\s\"',;]{{4,}}))")
_ASSIGNED = re.compile(r"[\"']?[ ]?(?:=>|[=:])[ ]?[\"']?$")
_NAMED = re.compile(rf"(?i){_NAME}\W{{0,6}}$")
#: Other writings of the signs in an address, by which base spans are hidden from the trees.
DISGUISES = ((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), ("@", "[.]"))

#: Documents in the sample, distinct examples learned from, trees, depth, rate, the precision a threshold must reach in calibration.
SAMPLE_BOUND = 20_000
EXAMPLE_BOUND = 20_000
TREES, DEPTH, RATE = 40, 3, 0.3
PRECISION = 0.95
LEAST_POSITIVES = 5
CONTEXT = 24

OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans: leftmost non-overlapping matches of each pattern that pass its check."""
    found = []
    at = text.find("@")
    low = 0
    while at >= 0:
        # a match lies inside the run of its characters around an @; the runs are searched one after the other, as one scan would
        start = at
        while start > low and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            found.append(("email", m.start(), m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    for m in IP.finditer(text) if "." in text else ():
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans proposed by the generators."""
    found = []
    # the surroundings of all marks, merged: only they are searched for the kinds that need a mark
    zones: list[list[int]] = []
    for m in _MARK.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if zones and a <= zones[-1][1]:
            zones[-1][1] = b
        else:
            zones.append([a, b])
    for a, b in zones:
        for kind, pattern in GENERATORS:
            found += [(kind, *m.span()) for m in pattern.finditer(text, a, b)]
    secrets = {m.span(m.lastindex) for m in NAMED_VALUE.finditer(text)}
    if zones:
        secrets |= {m.span() for m in TOKEN.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])}
    return found + [("secret", *span) for span in sorted(secrets)]


def features(kind: str, s: str, before: str, after: str) -> list[float]:
    """Format: length, digits, separators, classes, variety. Context: the text before, assignment, quotes, neighbours."""
    digits = _digits(s)
    n = max(len(s), 1)
    parts = re.split(r"[^0-9]+", s.strip("+() "))
    letters = sum(c.isalpha() for c in s)
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    return [
        float(_ORDER[kind]), float(n), float(len(digits)), len(digits) / n, float(sum(c in " -.()/" for c in s)), float(s.count(".")), float(s.count("@")),
        float(max((len(p) for p in parts), default=0)), float(len(parts)), float(s[:1] == "+"), float(digits[:1] in ("3", "4", "5", "6")), len(set(s)) / n,
        sum(c in "abcdef" for c in s) / n, sum(c.isupper() for c in s) / n, float(bool(_ASSIGNED.search(before))), float(bool(_NAMED.search(before[:-1] if before[-1:] in "\"'" else before))),
        float(before[-1:] in ("\"", "'")), float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), letters / n, turns / n,
    ]


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The span, the text before it and the text behind it, as ``features`` takes them."""
    return text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 2]


def hidden(kind: str, s: str, before: str, choice: int) -> tuple[str, str]:
    """The span and the text before it without the marks by which its kind is told."""
    at, dot = DISGUISES[choice % len(DISGUISES)]
    if kind == "email":
        name, host = s.split("@", 1)
        return name + at + host.replace(".", dot), before
    if kind == "ip":
        return s.replace(".", dot if choice % 2 else "[.]"), before
    if kind == "phone":
        return s.lstrip("+"), before
    if kind == "secret":
        return s, re.sub(rf"(?i){_NAME}[\"']?\s*(?:=>|[=:])?\s*([\"']?)$", r"\1", before)
    return s, before


def examples(text: str) -> Iterator[tuple[list[float], int]]:
    """(features, label) of the spans of a text that can be learned from."""
    base = base_spans(text)
    for kind, a, b in base:
        s, before, after = around(text, a, b)
        choice = zlib.crc32(s.encode())
        if kind == "card" or kind == "phone":
            # the same number in another grouping: not as it stands in the text, but as generators would propose it
            s = re.sub(r"[\x20-]", ("", " ", "-", ".")[choice % 4], s) if choice % 2 else s
        s, before = hidden(kind, s, before, choice)
        yield features(kind, s, before, after), 1
    for kind, a, b in candidates(text):
        touched = {k for k, x, y in base if x < b and a < y}
        s, before, after = around(text, a, b)
        if kind == "secret":
            far = text[max(0, a - 40) : a]
            named = _NAMED.search(re.sub(r"[\"']?\s*(?:=>|[=:])\s*[\"']?$", "", far))
            if named and ("=" in far[named.start() :] or not s.isalpha()):
                yield features(kind, s, before, after), 1
                s, before = hidden(kind, s, far, 0)
                yield features(kind, s, before[-CONTEXT:], after), 1
            elif kind not in touched:
                yield features(kind, s, before, after), 0
        elif kind not in touched:
            digits = len(_digits(s))
            failed = {"email": False, "ip": any(int(p) > 255 for p in re.findall("[0-9]+", s)), "card": not 14 <= digits <= 19 or not luhn(_digits(s)), "phone": not 10 <= digits <= 15}[kind]
            if touched or failed:
                yield features(kind, s, before, after), 0


@dataclass
class Trees:
    """Boosted regression trees of one depth, as flat arrays; ``thresholds``: the least calibrated probability by kind (2: never)."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float
    slope: float
    shift: float
    thresholds: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting on logistic loss with exact split search over at most 64 cuts a feature."""
    inner = 2**DEPTH - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    below = [x[:, j, None] > c[None, :] for j, c in enumerate(cuts)]
    mean = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(mean / (1 - mean)))
    raw = np.full(len(x), start)
    trees = ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        g, h = y - p, p * (1 - p) + 1e-6
        f, t, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**DEPTH)
        node = np.zeros(len(x), int)
        for k in range(inner):
            own = node == k
            if own.any():
                gs, hs = g[own].sum(), h[own].sum()
                best = 1e-6
                for j, mask in enumerate(below):
                    if not mask.shape[1]:
                        continue
                    right = mask[own].T @ np.column_stack([g[own], h[own]])
                    gain = right[:, 0] ** 2 / (right[:, 1] + 1) + (gs - right[:, 0]) ** 2 / (hs - right[:, 1] + 1) - gs**2 / (hs + 1)
                    b = int(np.argmax(gain))
                    if gain[b] > best:
                        best, f[k], t[k] = gain[b], j, cuts[j][b]
            node[own] = 2 * k + 1 + (x[own, f[k]] > t[k])
        at = node - inner
        for k in range(2**DEPTH):
            own = at == k
            leaf[k] = RATE * g[own].sum() / (h[own].sum() + 1)
        raw += leaf[at]
        for into, what in zip(trees, (f, t, leaf), strict=True):
            into.append(what)
    return Trees(np.array(trees[0]), np.array(trees[1]), np.array(trees[2]), start, 1.0, 0.0, dict.fromkeys(KINDS, 2.0))


def calibrated(trees: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """Platt scaling on the calibration fold, then for each kind the least probability from which on its precision is reached."""
    raw = trees.raw(x)
    z = np.column_stack([raw, np.ones(len(raw))])
    w = np.array([1.0, 0.0])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(v: np.ndarray) -> float:
        margin = z @ v
        return float((np.logaddexp(0, margin) - target * margin).sum() + 5e-3 * ((v - [1, 0]) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (target - p) - 1e-2 * (w - [1, 0]))
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    trees.slope, trees.shift = max(float(w[0]), 1e-3), float(w[1])
    p = trees.probability(x)
    for i, kind in enumerate(KINDS):
        own = x[:, 0] == i
        if (y[own] > 0).sum() < LEAST_POSITIVES:
            continue
        order = np.argsort(-p[own], kind="stable")
        q, hit = p[own][order], np.cumsum(y[own][order])
        last = np.append(q[1:] != q[:-1], True)
        good = np.flatnonzero(last & (hit / np.arange(1, len(q) + 1) >= PRECISION))
        if len(good):
            k = int(good[-1])
            trees.thresholds[kind] = max(0.5, float(q[k] + (q[k + 1] if k + 1 < len(q) else 0)) / 2)
    return trees


def fit(docs: DataFrame) -> Trees:
    """Trained on the examples in at most SAMPLE_BOUND documents, EXAMPLE_BOUND distinct ones, both in the order of a hash; features are
    made by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            x, y = [], []
            for text in batch.column("text").to_pylist():
                for values, label in examples(text):
                    x.append(np.array(values, np.float32).tobytes())
                    y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32())], ["x", "y"])

    ids = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = [(int(r[0]), 0) for r in common.bounded_rows(ids, "doc_id", SAMPLE_BOUND, 10).collect()]
    sample = common.sampled_texts(docs.where("text is not null"), sorted(chosen)).select("text").distinct()
    counted = sample.mapInArrow(run, "x binary, y int").groupBy("x").agg(F.avg("y").alias("y"))
    rows = common.bounded_rows(counted, "x", EXAMPLE_BOUND, 10).collect()
    width = len(features("ip", "0", "", ""))
    if not rows:
        return calibrated(boost(np.zeros((0, width)), np.zeros(0)), np.zeros((0, width)), np.zeros(0))
    rows.sort(key=lambda r: hashlib.md5(bytes(r["x"])).digest())
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float)
    y = np.array([r["y"] for r in rows], float)
    fifth = np.arange(len(y)) % 5 == 4
    return calibrated(boost(x[~fifth], y[~fifth]), x[fifth], y[fifth])


def spans_of(text: str, trees: Trees) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): accepted candidates join by falling probability where they overlap no span yet."""
    base = base_spans(text)
    proposed = candidates(text)
    if not proposed:
        return base, base
    x = np.array([features(kind, *around(text, a, b)) for kind, a, b in proposed])
    p = trees.probability(x)
    every = list(base)
    for k in np.argsort(-p, kind="stable"):
        kind, a, b = proposed[k]
        if p[k] >= trees.thresholds[kind] and all(b <= s or a >= e for _, s, e in every):
            every.append((kind, a, b))
    return base, sorted(every, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_added of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(trees or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            found = [spans_of(t or "", model.value) for t in batch.column("text").to_pylist()]
            counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in BASE_KINDS}
            digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield common.record(OUT, doc_id=batch.column("doc_id"), **counts, base_sha256=digest, spans=[joined(e) for _, e in found], n_added=[len(e) - len(b) for b, e in found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``docs`` with its text redacted and n_chars, if there, counted anew; all other columns as they are. A null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(trees or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            texts = [None if t is None else redacted_text(t, spans_of(t, model.value)[1]) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))

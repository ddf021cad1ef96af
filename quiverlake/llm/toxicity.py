"""Operator 4, toxicity: weak supervision. Lexicon and pattern voters, a generative label model, a linear classifier on its posteriors.

Voters fire or abstain on a document. Their lexicon is a fixed list plus the words and word beginnings that a bounded sample of
labelled training documents shows to be far more frequent in toxic ones; every stem is a voter, and so are some patterns. From here on no
label is used. The label model looks at a bounded sample of training documents, labelled or not: it is tree-structured, every voter has
an accuracy given the hidden class and a correlation with its parent voter, the tree being the strongest conditional dependencies, and
is estimated by expectation maximisation. The toxic class has kinds, found as groups of stems that fire together, since insults of one
language say nothing of texts in others; a posterior is the sum over the kinds. A ridge logistic regression on counts of lexicon hits is
trained on the posteriors and scores every whole text; its cut, placed at 0.7, is the one of the best expected F1 under the posteriors.

Nulls: a null text is an empty one (no voter fires). Labels that are neither 0 nor 1 are no labels; without any, only the fixed list
votes. Rows without doc_id are in no sample and are scored like any other. Repeated rows stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Insults that vote even where no label mentions them.
INSULTS = ("idiot", "moron", "stupid", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass")
#: Bounds on the labelled documents of each class and on the documents of the label model; lengths of word beginnings.
CLASS_BOUND = 3000
DOCUMENT_BOUND = 20_000
PREFIXES = (4, 5, 6, 7, 8)
#: A stem votes if its likelihood-ratio statistic and its ratio of the toxic to the clean share reach these; no further cut is made.
LEAST_G, LEAST_RATIO = 60.0, 20.0
#: Patterns that vote beside the stems, and which of them stands for two hits or more.
PATTERNS, TWO_HITS = 6, 1
#: The share of the rarer stem's documents on which stems of one kind fire together, and the weight of a prior of one half on each rate.
TOGETHER = 0.15
SMALL = 0.2
#: Documents that outweigh the assumption that a voter does not depend on its parent.
DOUBT = 8.0
RIDGE = 1e-3
CUT = 0.7

_WORD = re.compile(r"[^\W\d_]+")
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def stems_of(text: str) -> set[str]:
    """Whole words (marked by a final $) and word beginnings of a text."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
    return {w + "$" for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) >= k}


def mined(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """Stems that tell toxic from clean sample documents, shortest beginnings first; none that another one begins."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[label].update(stems_of(text or ""))
        # what a task saw in no toxic document is reported too: other tasks may have
        names = list(seen[1] | seen[0])
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([seen[1][s] for s in some]), pa.array([seen[0][s] for s in some])], ["stem", "t", "c"])

    t, c = F.col("t"), F.col("c")
    rate, rest = (t + c) / (toxic + clean), float(max(toxic, 1)) / (toxic + clean or 1)
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    statistic = 2 * (part(t, (t + c) * rest) + part(c, (t + c) * (1 - rest)) + part(toxic - t, toxic * (1 - rate)) + part(clean - c, clean * (1 - rate)))
    ratio = (t / max(toxic, 1)) / ((c + 0.5) / max(clean, 1))
    rows = (
        sample.select("label", "text").mapInArrow(partial, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where((ratio >= LEAST_RATIO) & (statistic >= LEAST_G)).collect()
    )
    return chosen_stems([tuple(r) for r in rows])


def chosen_stems(rows: list[tuple[str, int, int]]) -> list[str]:
    """Of (stem, toxic, clean) the purest form of each family, most frequent first: a beginning gives way to a longer stem that has
    most of its toxic documents and fewer clean ones, and otherwise stands for all that it begins."""
    longest = sorted(rows, key=lambda r: (-len(r[0]), r[0]))
    pure = [r for r in longest if not any(e[0] != r[0] and e[0].startswith(r[0]) and e[1] >= 0.85 * r[1] and e[2] < r[2] for e in longest)]
    kept: dict[str, int] = {}
    for stem, t, _ in reversed(pure):
        if not any(stem[:k] in kept for k in range(1, len(stem))):
            kept[stem] = t
    return sorted(kept, key=lambda s: (-kept[s], s))


class Lexicon:
    """Counts hits of stems at word beginnings (a final $: whole words only)."""

    def __init__(self, stems: list[str]):
        self.stems = stems
        self.at = {s: i for i, s in enumerate(stems)}
        self.automaton = ahocorasick.Automaton()
        for bare in {s.rstrip("$") for s in stems}:
            self.automaton.add_word(bare, bare)
        if stems:
            self.automaton.make_automaton()

    def row(self, text: str) -> tuple[dict[int, int], list[float]]:
        """Hits by stem, and the pattern features: shouted hits, hits followed by an exclamation mark, words."""
        hits: dict[int, int] = {}
        shouted = exclaimed = 0
        low = text.lower()
        n = len(low)
        for end, bare in self.automaton.iter(low) if self.stems else ():
            start = end - len(bare) + 1
            if start and low[start - 1].isalpha():
                continue
            found = self.at.get(bare)
            if found is None:
                if end + 1 < n and low[end + 1].isalpha():
                    continue
                found = self.at.get(bare + "$")
            if found is not None:
                hits[found] = hits.get(found, 0) + 1
                shouted += len(low) == len(text) and text[start : end + 1].isupper()
                exclaimed += low[end + 1 : end + 2] == "!"
        return hits, [shouted, exclaimed, low.count(" ") + low.count("\n") + 1]


def vector(hits: dict[int, int], extra: list[float], width: int) -> tuple[list[int], list[float]]:
    """Linear features other than zero, as places and values: log counts by stem, then of all hits, hits by word, shouted hits, exclaimed hits."""
    total = sum(hits.values())
    if not total:
        return [], []
    groups = (math.log1p(total), min(5.0, 100 * total / extra[2]), math.log1p(extra[0]), math.log1p(extra[1]))
    return [*hits, *range(width, width + 4)], [*(math.log1p(n) for n in hits.values()), *groups]


def votes(hits: dict[int, int], extra: list[float], width: int, listed: set[int]) -> list[int]:
    """The voters that fire: one for each stem, then the fixed list and the patterns."""
    total = sum(hits.values())
    patterns = (any(i in listed for i in hits), total >= 2, total >= 4, len(hits) >= 2, extra[0] >= 1, extra[1] >= 1)
    return [*hits, *(width + k for k, fires in enumerate(patterns) if fires)]


def kinds_of(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A group for each voter: those that fire together on TOGETHER of the rarer one's documents at least, directly or by a chain."""
    x = v.astype(float)
    both = (x * n[:, None]).T @ x
    alone = np.diag(both)
    linked = both >= np.maximum(TOGETHER * np.minimum(alone[:, None], alone[None, :]), 3)
    group = np.arange(v.shape[1])
    while True:
        least = np.minimum(group, np.where(linked, group[None, :], len(group)).min(axis=1, initial=len(group)))
        if (least == group).all():
            return np.unique(group, return_inverse=True)[1]
        group = least


def label_model(v: np.ndarray, n: np.ndarray | None = None, rounds: int = 30, stems: int = 0) -> np.ndarray:
    """Posterior P(toxic) of each row of the vote matrix, from the tree-structured generative model fitted by EM; ``n``: how often a row
    occurs, ``stems``: the leading voters, whose groups are the kinds of the toxic class (0: all voters, and one kind)."""
    rows, m = v.shape
    if not rows:
        return np.zeros(0)
    n = np.ones(rows) if n is None else n
    x = v.astype(float)
    own = v[:, : stems or m]
    group = kinds_of(own, n) if stems else np.zeros(m, int)
    fired = own.astype(float) @ np.eye(group.max() + 1)[group]
    # to begin with, documents with two hits or more are toxic
    strong = v[:, stems + TWO_HITS] if stems else own.sum(axis=1) >= 2
    used = np.flatnonzero(np.bincount(fired.argmax(axis=1), weights=n * strong, minlength=fired.shape[1]) >= 3)
    used = used if len(used) else np.arange(1)
    # the share of each class in each row: clean first, then the kinds
    q = np.zeros((rows, 1 + len(used)))
    q[np.arange(rows), 1 + fired[:, used].argmax(axis=1)] = np.where(strong, 0.99, 0.01)
    q[:, 0] = 1 - q[:, 1:].sum(axis=1)
    parent = np.full(m, -1)
    for step in range(rounds):
        if step % 10 == 0:
            parent = dependency_tree(x, 1 - q[:, 0], n)
        weight = n[:, None] * q
        total = weight.sum(axis=0)
        log = np.tile(np.log((total + 0.5) / (n.sum() + 1)), (rows, 1))
        for j in range(m):
            up = x[:, parent[j]] if parent[j] >= 0 else np.zeros(rows)
            alone = (weight.T @ x[:, j] + 0.5 * SMALL) / (total + SMALL)
            for state in (up, 1 - up):
                # little evidence of a correlation is none: else the few toxic documents left in the clean class explain one another
                rate = (weight.T @ (x[:, j] * state) + DOUBT * alone) / (weight.T @ state + DOUBT)
                log += state[:, None] * np.where(x[:, j, None] > 0, np.log(rate), np.log1p(-rate))
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - q).max() < 1e-5
        q = new
        if done:
            break
    return 1 - q[:, 0]


def dependency_tree(x: np.ndarray, q: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Parents of the voters in the maximum spanning tree of their mutual information given the class."""
    m = x.shape[1]
    n = np.ones(len(x)) if n is None else n
    info = np.zeros((m, m))
    for weight in (n * (1 - q), n * q):
        both = (x * weight[:, None]).T @ x + 0.25
        one = (x * weight[:, None]).sum(axis=0) + 0.5
        total = weight.sum() + 1
        for a in (0, 1):
            for b in (0, 1):
                joint = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): total - one[:, None] - one[None, :] + both}[a, b]
                joint = np.maximum(joint, 0.1) / total
                pa_, pb = (one / total if a else 1 - one / total), (one / total if b else 1 - one / total)
                info += total / (n.sum() + 2) * joint * np.log(joint / np.maximum(pa_[:, None] * pb[None, :], 1e-9))
    parent = np.full(m, -1)
    if m < 2:
        return parent
    best, source, done = info[0].copy(), np.zeros(m, int), np.zeros(m, bool)
    done[0] = True
    for _ in range(m - 1):
        j = int(np.argmax(np.where(done, -np.inf, best)))
        parent[j], done[j] = source[j], True
        closer = info[j] > best
        best[closer], source[closer] = info[j][closer], j
    return parent


def regression(x: np.ndarray, q: np.ndarray, n: np.ndarray, steps: int = 600) -> np.ndarray:
    """Ridge logistic regression on soft labels of rows that occur ``n`` times, by accelerated projected gradients. Hits never speak against
    toxicity, so all weights but the last, the bias, are kept at zero or above."""
    z = np.column_stack([x, np.ones(len(x))])
    share = n / n.sum()
    rate = 4 / max(float(np.linalg.eigvalsh((z * share[:, None]).T @ z)[-1]), 1e-6)
    w = ahead = np.zeros(z.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead - rate * (z.T @ (share * (p - q)) + RIDGE * np.append(ahead[:-1], 0))
        new[:-1] = np.maximum(new[:-1], 0)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def cut_of(s: np.ndarray, q: np.ndarray, n: np.ndarray) -> float:
    """The raw score of the best expected F1 under the posteriors ``q`` of rows that occur ``n`` times: the middle between its neighbours."""
    order = np.argsort(-s, kind="stable")
    s, q, n = s[order], q[order], n[order]
    last = np.append(s[1:] != s[:-1], True)
    f1 = np.where(last, 2 * np.cumsum(q * n) / (np.cumsum(n) + max((q * n).sum(), 1e-9)), -1)
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[list[str], np.ndarray, float]:
    """(stems, weights, cut). ``held_out`` is a condition on doc_id."""
    chosen = common.labelled_sample(labels, "toxic", ~held_out, CLASS_BOUND, 4)
    toxic = sum(y for _, y in chosen)
    # copies of one text speak once
    labelled = common.written(common.sampled_texts(docs, chosen).groupBy("text").agg(F.max("label").alias("label")), "toxicity-labelled")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    stems = mined(labelled, sizes.get(1, 0), sizes.get(0, 0)) if toxic else []
    stems += [w + "$" for w in INSULTS if not any(w[:k] in stems for k in range(1, len(w) + 1)) and w + "$" not in stems]
    width = len(stems)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        listed = {i for i, s in enumerate(stems) if s.rstrip("$") in INSULTS}
        for batch in common.blocks(batches):
            rows = [lexicon.row(t or "") for t in batch.column("text").to_pylist()]
            x = [vector(h, e, width) for h, e in rows]
            columns = ([a for a, _ in x], [v for _, v in x], [votes(h, e, width, listed) for h, e in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(k)) for c, k in zip(columns, (pa.int32(), pa.float64(), pa.int32()), strict=True)], ["at", "x", "v"])

    # documents without a hit differ in nothing: they are counted, not collected
    ids = docs.where(~held_out & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    some = [(int(r[0]), 0) for r in common.bounded_rows(ids, "doc_id", DOCUMENT_BOUND, 44).collect()]
    rows = common.sampled_texts(docs, sorted(some)).select("text").mapInArrow(featured, "at array<int>, x array<double>, v array<int>")
    rows = sorted(tuple(map(tuple, r[:3])) + (r[3],) for r in rows.groupBy("at", "x", "v").count().collect())
    if not any(r[2] for r in rows):
        return stems, np.append(np.zeros(width), [4.0, 0, 0, 0, -2.0]), 0.0
    n = np.array([r[3] for r in rows], float)
    x, v = np.zeros((len(rows), width + 4)), np.zeros((len(rows), width + PATTERNS), bool)
    for k, (at, values, fired, _) in enumerate(rows):
        x[k, list(at)] = values
        v[k, list(fired)] = True
    q = label_model(v, n, stems=width)
    w = regression(x, q, n)
    return stems, w, cut_of(x @ w[:-1] + w[-1], q, n)


def scored(lexicon: Lexicon, w: np.ndarray, cut: float, texts: list[str | None]) -> np.ndarray:
    """Scores of texts, with the cut at CUT."""
    width, shift, weights = len(lexicon.stems), float(np.log(CUT / (1 - CUT))), w.tolist()
    raw = np.array([sum(weights[i] * x for i, x in zip(*vector(*lexicon.row(t or ""), width), strict=True)) for t in texts], float) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(raw - cut + shift, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; learns from labels(doc_id, toxic) not held out."""
    stems, w, cut = fit(docs, labels, held_out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in common.blocks(batches):
            p = scored(lexicon, w, cut, batch.column("text").to_pylist())
            yield common.record(OUT, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=p, predicted=(p >= CUT).astype(np.int32))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return base.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``docs`` without the rows predicted toxic, by the same scores as ``classify``; all columns pass through, nothing is shuffled."""
    stems, w, cut = fit(docs, labels, held_out)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in common.blocks(batches):
            yield batch.filter(pa.array(scored(lexicon, w, cut, batch.column("text").to_pylist()) < CUT))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), common.fold("doc_id", 3, 1))

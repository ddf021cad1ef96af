"""Proximity graphs: building, pruning, searching, merging, statistics and repair. Edges are (src, nbrs array), neighbours nearest first.

A shard is built and searched by one task; ``clusters.sharded_under`` makes shards of a stated largest size, counted on the real rows.
Queries are a stated set and go to every shard, whose partial answers are merged: no task or executor ever needs the whole index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persisted
from . import knn

#: Pruning factor, candidates of a prune, slack of degrees while building.
ALPHA = 1.2
MOST_CANDIDATES = 750
#: Points of a shard where shards are made by hash.
SHARD_POINTS = 100_000
SLACK = 1.3
#: Queries that a shard searches at once, and marks of their visited nodes.
SEARCHED_AT_ONCE, SEEN_AT_ONCE = 512, 64_000_000


def distances(x: np.ndarray, q: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Distances of rows to one vector: squared, without the vector's own norm (fast_l2), negative products, or 1 - cosine (1 where a norm is zero)."""
    if metric == "l2":
        return ((x - q) ** 2).sum(axis=1)
    products = x @ q
    if metric == "fast_l2":
        return (x * x).sum(axis=1) - 2 * products
    if metric == "ip":
        return -products
    norms = np.sqrt((x * x).sum(axis=1) * (q @ q))
    return 1 - np.divide(products, norms, out=np.zeros(len(x)), where=norms > 0)


def occlusion(metric: str, to_point: np.ndarray, between: np.ndarray, factor: float) -> np.ndarray:
    """How far a taken neighbour occludes candidates: a candidate is occluded while this is above the factor.

    Distances: the candidate's distance to the point over that to the taken one. Inner products have no scale of distances: a candidate is
    occluded at this factor if it is more similar to the taken one than ``factor`` times as similar to the point.
    """
    if metric == "ip":
        return np.where(-between > factor * -to_point, factor + 0.01, 0.0)
    return np.where(between > 0, to_point / np.maximum(between, 1e-300), np.inf)


def robust_prune(
    x: np.ndarray, point: int, pool: list[int], degree: int, alpha: float = ALPHA, labels: list[set] | None = None, saturate: bool = False, metric: str = "l2"
) -> list[int]:
    """At most ``degree`` neighbours of ``point`` from a pool.

    In order of distance a candidate is taken unless a taken one occludes it: is nearer to it than the point by more than the factor,
    which starts at 1 and grows by 1.2 up to ``alpha``. With labels only a candidate whose labels the taken one has can be occluded.
    """
    ids = np.array(sorted(set(pool) - {point}), int)
    if not len(ids):
        return []
    d = distances(x[ids], x[point], metric)
    order = np.lexsort((ids, d))[:MOST_CANDIDATES]
    ids, d = ids[order], d[order]
    worst = np.zeros(len(ids))
    taken: list[int] = []
    open_ = np.ones(len(ids), bool)
    factor = 1.0
    while factor <= alpha + 1e-9 and len(taken) < degree:
        for i in range(len(ids)):
            if len(taken) >= degree:
                break
            if not open_[i] or worst[i] > factor:
                continue
            open_[i] = False
            taken.append(int(ids[i]))
            rest = np.flatnonzero(open_[i + 1 :]) + i + 1
            if labels is not None:
                rest = np.array([r for r in rest if labels[ids[r]] <= labels[ids[i]]], int)
            if len(rest):
                worst[rest] = np.maximum(worst[rest], occlusion(metric, d[rest], distances(x[ids[rest]], x[ids[i]], metric), factor))
        factor *= 1.2
    if saturate and alpha > 1:
        taken += [int(i) for i in ids if int(i) not in taken][: degree - len(taken)]
    return taken


def greedy_search(
    x: np.ndarray, nbrs: list, starts: list[int], q: np.ndarray, width: int, allowed: np.ndarray | None = None, metric: str = "l2", wanted: np.ndarray | None = None
) -> tuple[list[int], list[float], set[int], int]:
    """(nearest ids, their distances, all expanded ids, hops): expands the closest unexpanded node of a list of ``width``.

    ``allowed``: nodes that may be entered at all. ``wanted``: nodes that may be results; others lead the way, and a list of their own holds
    the ``width`` nearest wanted ones, so that however many nodes are unwanted no wanted one is pushed out.
    """
    first = np.array(sorted(set(starts)), int)
    seen = np.zeros(len(x), bool)
    seen[first] = True
    reach = sorted(zip(distances(x[first], q, metric).tolist(), first.tolist(), strict=True))
    queue, hits = reach[:width], [r for r in reach if wanted is None or wanted[r[1]]]
    done: set[int] = set()
    while True:
        # with unwanted nodes the search goes on until ``width`` wanted ones are nearer than all that is left
        now = next((n for _, n in queue if n not in done), None)
        if now is None:
            break
        done.add(now)
        fresh = np.array(nbrs[now], int)
        fresh = fresh[~seen[fresh]] if len(fresh) else fresh
        if allowed is not None and len(fresh):
            fresh = fresh[allowed[fresh]]
        if len(fresh):
            fresh = np.unique(fresh)
            seen[fresh] = True
            more = list(zip(distances(x[fresh], q, metric).tolist(), fresh.tolist(), strict=True))
            hits = sorted(hits + [r for r in more if wanted is None or wanted[r[1]]])[:width]
            queue = sorted(queue + more)
            if wanted is None:
                queue = queue[:width]
            else:
                limit = hits[-1][0] if len(hits) >= width else np.inf
                queue = [r for k, r in enumerate(queue) if k < width or r[0] < limit]
    found = hits if wanted is not None else queue
    return [n for _, n in found], [d for d, _ in found], done, len(done)


def _put(dist: np.ndarray, node: np.ndarray, done: np.ndarray, row: np.ndarray, new_dist: np.ndarray, new_node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists, a row each and in order of (distance, node), with new entries of some rows (in order of the rows) put in, cut to ``most``."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    own, count = row[first], np.diff(np.r_[first, len(row)])
    at, slot, old = np.repeat(np.arange(len(own)), count), np.arange(len(row)) - np.repeat(first, count), dist.shape[1]
    wide = (len(own), old + int(count.max()))
    d, n, f = np.full(wide, np.inf), np.full(wide, np.iinfo(np.int64).max), np.ones(wide, bool)
    d[:, :old], n[:, :old], f[:, :old] = dist[own], node[own], done[own]
    d[at, old + slot], n[at, old + slot], f[at, old + slot] = new_dist, new_node, False
    order = np.argsort(d, axis=1)
    ranked = np.take_along_axis(d, order, 1)
    tied = np.flatnonzero(((ranked[:, 1:] == ranked[:, :-1]) & (ranked[:, 1:] < np.inf)).any(axis=1))
    order[tied] = np.lexsort((n[tied], d[tied]), axis=1)
    order = order[:, :most]
    if order.shape[1] > old:
        more = ((0, 0), (0, order.shape[1] - old))
        dist, node, done = np.pad(dist, more, constant_values=np.inf), np.pad(node, more, constant_values=np.iinfo(np.int64).max), np.pad(done, more, constant_values=True)
    for held, some in ((dist, d), (node, n), (done, f)):
        held[own, : order.shape[1]] = np.take_along_axis(some, order, 1)
    return dist, node, done


def neighbour_table(nbrs: list) -> np.ndarray:
    """(nodes, largest degree): the distinct neighbours of each node, filled up with the number of nodes."""
    distinct = [np.unique(np.asarray(row, int)) for row in nbrs]
    out = np.full((len(nbrs), max(map(len, distinct), default=0)), len(nbrs))
    for at, row in enumerate(distinct):
        out[at, : len(row)] = row
    return out


def greedy_search_many(
    x: np.ndarray, table: np.ndarray, starts: list[int], q: np.ndarray, width: int, metric: str = "l2", wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, distances, hops) of ``greedy_search`` for some queries at once, over a ``neighbour_table``; free places have infinite distances.

    All queries expand a node a round. A node that ``greedy_search`` drops from its queue is beyond the width and not below the last wanted one,
    and stays so: here it counts as expanded.
    """
    n, squares = len(x), (x * x).sum(axis=1)
    first = np.array(sorted(set(starts)), int)
    norms = np.array([v @ v for v in q])

    def measured(row: np.ndarray, node: np.ndarray) -> np.ndarray:
        if metric == "l2":
            return ((x[node] - q[row]) ** 2).sum(axis=1)
        products = (x[node] * q[row]).sum(axis=1)
        if metric == "fast_l2":
            return squares[node] - 2 * products
        if metric == "ip":
            return -products
        size = np.sqrt(squares[node] * norms[row])
        return 1 - np.divide(products, size, out=np.zeros(len(row)), where=size > 0)

    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    seen[:, first] = True
    empty = lambda: (np.full((len(q), width), np.inf), np.full((len(q), width), np.iinfo(np.int64).max), np.ones((len(q), width), bool))
    queue, hits, hops = empty(), empty(), np.zeros(len(q), int)
    row, node = np.repeat(np.arange(len(q)), len(first)), np.tile(first, len(q))
    while len(row):
        dist = measured(row, node)
        limit = np.full(len(q), -np.inf)
        if wanted is not None:
            good = wanted[node] & (dist <= hits[0][row, -1])
            if good.any():
                hits = _put(*hits, row[good], dist[good], node[good], width)
            limit = hits[0][:, -1]
        good = (dist <= queue[0][row, width - 1]) | (dist < limit[row])
        if good.any():
            queue = _put(*queue, row[good], dist[good], node[good], width if wanted is None else n)
        if wanted is not None and queue[0].shape[1] > width:
            keep = queue[0] < limit[:, None]
            keep[:, :width] = True
            queue[2][~keep] = True
            most = int((keep & (queue[0] < np.inf)).sum(axis=1).max())
            queue = tuple(c[:, : max(most, width)].copy() for c in queue)
        row = row[:0]
        while not len(row):
            at = queue[2].argmin(axis=1)
            active = np.flatnonzero(~queue[2][np.arange(len(q)), at])
            if not len(active):
                break
            now = queue[1][active, at[active]]
            queue[2][active, at[active]] = True
            hops[active] += 1
            near = table[now]
            fresh, column = np.nonzero(~seen[active[:, None], near])
            row, node = active[fresh], near[fresh, column]
            seen[row, node] = True
    found = hits if wanted is not None else queue
    return found[1], found[0], hops


def medoid_index(x: np.ndarray) -> int:
    return int(np.argmin(distances(x, x.mean(axis=0))))


def build_local(x: np.ndarray, degree: int, width: int, alpha: float = ALPHA, labels: list[set] | None = None, metric: str = "l2", saturate: bool = False) -> tuple[list[list[int]], int]:
    """(neighbours, start) of one shard: points are inserted in order of their ids, with reverse edges under slack and a final trim."""
    n = len(x)
    nbrs: list[list[int]] = [[] for _ in range(n)]
    if not n:
        return nbrs, -1
    start = medoid_index(x)
    for p in range(n):
        insert_local(x, nbrs, [start], p, degree, width, alpha, labels, metric, saturate)
    return trimmed(x, nbrs, degree, alpha, labels, metric), start


def insert_local(x: np.ndarray, nbrs: list[list[int]], starts: list[int], p: int, degree: int, width: int, alpha: float = ALPHA, labels: list[set] | None = None, metric: str = "l2", saturate: bool = False) -> None:
    """Links point ``p`` from what a search for it visits, and back; lists that outgrow the slack are pruned."""
    visited = greedy_search(x, nbrs, starts, x[p], width, metric=metric)[2]
    nbrs[p] = robust_prune(x, p, list(visited) + nbrs[p], degree, alpha, labels, saturate, metric)
    linked_back(x, nbrs, p, degree, alpha, labels, metric)


def linked_back(x: np.ndarray, nbrs: list[list[int]], p: int, degree: int, alpha: float, labels: list[set] | None, metric: str) -> None:
    """Reverse edges of ``p``, under slack."""
    most = int(degree * SLACK)
    for o in nbrs[p]:
        if p not in nbrs[o]:
            nbrs[o].append(p)
            if len(nbrs[o]) > most:
                nbrs[o] = robust_prune(x, o, nbrs[o], degree, alpha, labels, metric=metric)


def trimmed(x: np.ndarray, nbrs: list[list[int]], degree: int, alpha: float, labels: list[set] | None = None, metric: str = "l2") -> list[list[int]]:
    return [n if len(n) <= degree else robust_prune(x, p, n, degree, alpha, labels, metric=metric) for p, n in enumerate(nbrs)]


EDGES = "shard long, src long, nbrs array<long>, is_start boolean"


def build(sharded: DataFrame, degree: int = 32, width: int = 64, alpha: float = ALPHA, metric: str = "l2", saturate: bool = False, book=None) -> DataFrame:
    """(shard, src, nbrs, is_start) of (shard, id, vec): one task a shard. ``book``: distances while building are those of decoded codes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        x = np.array(pdf["vec"].tolist(), np.float64)
        if book is not None and len(x):
            x = book.restored(book.encode(x))
        nbrs, start = build_local(x, degree, width, alpha, None, metric, saturate)
        return pd.DataFrame({"shard": pdf["shard"].to_numpy(), "src": ids, "nbrs": [ids[n].tolist() if n else [] for n in nbrs], "is_start": np.arange(len(ids)) == start})

    return sharded.select("shard", "id", "vec").groupBy("shard").applyInPandas(run, EDGES)


def inserted(sharded: DataFrame, edges: DataFrame, new: DataFrame, degree: int = 32, width: int = 64, alpha: float = ALPHA, metric: str = "l2") -> DataFrame:
    """(shard, src, nbrs, is_start) with the (shard, id, vec) points of ``new`` linked in, in order of their ids, each shard by one task."""
    old = sharded.select("shard", "id", "vec").join(edges.withColumnRenamed("src", "id"), ["shard", "id"])
    both = old.withColumn("old", F.lit(True)).unionByName(
        new.select("shard", "id", "vec").withColumn("nbrs", F.array().cast("array<bigint>")).withColumn("is_start", F.lit(False)).withColumn("old", F.lit(False)), allowMissingColumns=True
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        ids, x = pdf["id"].to_numpy(), np.array(pdf["vec"].tolist(), np.float64)
        place = {int(i): n for n, i in enumerate(ids)}
        nbrs = [[place[int(i)] for i in row if int(i) in place] for row in pdf["nbrs"]]
        is_start = pdf["is_start"].to_numpy(bool)
        if not is_start.any():
            is_start[medoid_index(x)] = True
        starts = np.flatnonzero(is_start).tolist()
        for p in np.flatnonzero(~pdf["old"].to_numpy(bool)).tolist():
            insert_local(x, nbrs, starts, p, degree, width, alpha, metric=metric)
        nbrs = trimmed(x, nbrs, degree, alpha, metric=metric)
        return pd.DataFrame({"shard": pdf["shard"].to_numpy(), "src": ids, "nbrs": [ids[n].tolist() if n else [] for n in nbrs], "is_start": is_start})

    return both.groupBy("shard").applyInPandas(run, EDGES)


def label_starts(labelled: list[set], seed: int = 1, tries: int = 25) -> dict[str, int]:
    """A start node of each label: of ``tries`` seeded candidates that carry it the one that starts fewest labels so far."""
    rng = np.random.default_rng(seed)
    used = np.zeros(len(labelled), int)
    out = {}
    for label in sorted(set().union(*labelled)) if labelled else []:
        own = [i for i, s in enumerate(labelled) if label in s]
        some = rng.choice(own, min(tries, len(own)), replace=False)
        best = min(some.tolist(), key=lambda i: (used[i], i))
        used[best] += 1
        out[label] = best
    return out


def build_filtered(sharded: DataFrame, degree: int = 32, width: int = 64, alpha: float = ALPHA, universal: str | None = None, metric: str = "l2") -> DataFrame:
    """(shard, src, nbrs, is_start, starts_label) of (shard, id, vec, labels): edges serve searches by label.

    A point is linked from what is visited from the starts of its labels among points that share one, and from the medoid among all;
    pruning keeps a candidate unless the occluding one carries all its labels. A universal label stands for every label.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        ids, x = pdf["id"].to_numpy(), np.array(pdf["vec"].tolist(), np.float64)
        own = [set(map(str, row)) for row in pdf["labels"]]
        every = set().union(*own) - {universal}
        own = [every if universal in s else s for s in own]
        carriers = {label: np.array([label in s for s in own]) for label in every}
        starts = label_starts(own)
        nbrs: list[list[int]] = [[] for _ in ids]
        centre = medoid_index(x)
        for p in range(len(ids)):
            pool = set(greedy_search(x, nbrs, [centre], x[p], width, metric=metric)[2])
            for label in sorted(own[p]):
                pool |= greedy_search(x, nbrs, [starts[label]], x[p], width, carriers[label], metric)[2]
            nbrs[p] = robust_prune(x, p, list(pool) + nbrs[p], degree, alpha, own, metric=metric)
            linked_back(x, nbrs, p, degree, alpha, own, metric)
        nbrs = trimmed(x, nbrs, degree, alpha, own, metric)
        label_of: dict[int, list[str]] = {}
        for label, node in starts.items():
            label_of.setdefault(node, []).append(label)
        return pd.DataFrame({
            "shard": pdf["shard"].to_numpy(), "src": ids, "nbrs": [ids[n].tolist() if n else [] for n in nbrs],
            "is_start": np.arange(len(ids)) == centre, "starts_label": [sorted(label_of.get(i, [])) for i in range(len(ids))],
        })

    return sharded.select("shard", "id", "vec", "labels").groupBy("shard").applyInPandas(run, EDGES + ", starts_label array<string>")


def build_stitched(points: DataFrame, degree: int = 32, width: int = 64, most: int = 64, alpha: float = ALPHA) -> DataFrame:
    """(src, nbrs): a graph for each label, their edges united and lists above ``most`` pruned. points: (id, vec, labels).

    A label's graph is built in shards of its own points, so a label that most points carry is no single task.
    """
    owner = points.select("id", "vec", F.explode(F.array_distinct("labels")).alias("label"))
    sizes = owner.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(SHARD_POINTS)))
    keyed = owner.join(sizes, "label").select("id", "vec", F.xxhash64("label", part).alias("shard"))
    pairs = build(keyed, degree, width, alpha).select("src", F.explode("nbrs").alias("dst"))
    return pruned(stitched(pairs), points, most, alpha)


SEARCHED = "qid long, id long, dist double, hops int, compared int"


def search(
    sharded: DataFrame, edges: DataFrame, queries: DataFrame, k: int, width: int, keep_label: str | None = None, metric: str = "l2",
    universal: str | None = None, unwanted: DataFrame | None = None, counted: bool = False,
) -> DataFrame:
    """(qid, rank, id, dist) by greedy search of every shard from its start.

    ``keep_label``: only results with this label (or the universal one), from the label's own starts where ``edges`` has them and the
    shard's start; a label that no point has raises. ``unwanted``: (id) of nodes that lead the way and are no results. ``counted``: with
    the columns hops (nodes expanded, over all shards) and shards. sharded: (shard, id, vec[, labels]); k may not exceed ``width``.
    """
    if k > width:
        raise ValueError("k must not be larger than the list width")
    filtered = keep_label is not None
    if filtered:
        known = F.array_contains("labels", keep_label) if universal is None else F.array_contains("labels", keep_label) | F.array_contains("labels", universal)
        if sharded.where(known).isEmpty():
            raise ValueError(f"unknown label {keep_label}")
    own = [c for c in ("nbrs", "is_start", "starts_label") if c in edges.columns]
    joined = sharded.select("shard", "id", "vec", *(["labels"] if filtered else [])).join(edges.select("shard", F.col("src").alias("id"), *own), ["shard", "id"])
    gone = F.lit(False)
    if unwanted is not None:
        joined = joined.join(unwanted.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
        gone = F.coalesce("gone", F.lit(False))
    joined = joined.withColumn("gone", gone)

    def block(parts: tuple) -> DataFrame:
        sent = sharded.sparkSession.sparkContext.broadcast(parts)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id").reset_index(drop=True)
            ids, x = pdf["id"].to_numpy(), np.array(pdf["vec"].tolist(), np.float64)
            place = {int(i): n for n, i in enumerate(ids)}
            nbrs = [[place[int(i)] for i in row if int(i) in place] for row in pdf["nbrs"]]
            starts = np.flatnonzero(pdf["is_start"].to_numpy(bool)).tolist() or [0]
            wanted = ~pdf["gone"].to_numpy(bool)
            if filtered:
                wanted &= np.array([not {keep_label, universal}.isdisjoint(map(str, row)) for row in pdf["labels"]])
                if "starts_label" in pdf:
                    starts += [n for n, row in enumerate(pdf["starts_label"]) if keep_label in row]
                elif wanted.any():
                    starts += [int(np.flatnonzero(wanted)[0])]
            qids, q = np.array(sent.value[0]), sent.value[1]
            links, some = neighbour_table(nbrs), max(16, min(SEARCHED_AT_ONCE, SEEN_AT_ONCE // len(ids)))
            rows = []
            for at in range(0, len(q), some) if wanted.any() else ():
                found, dist, hops = greedy_search_many(x, links, starts, q[at : at + some], width, metric, None if wanted.all() else wanted)
                query, place = np.nonzero(dist[:, :k] < np.inf)
                rows.append(pd.DataFrame({"qid": qids[at + query], "id": ids[found[query, place]], "dist": dist[query, place], "hops": hops[query], "compared": len(ids)}))
            none = pd.DataFrame([], columns=["qid", "id", "dist", "hops", "compared"])
            return (pd.concat(rows) if rows else none).astype({"qid": "int64", "id": "int64", "dist": "float64", "hops": "int32", "compared": "int32"})

        out = joined.groupBy("shard").applyInPandas(run, SEARCHED)
        return out if counted else out.select("qid", "id", "dist")

    out = knn.over_blocks(queries, [], block)
    best = knn.ranked(out.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k)
    if not counted or "hops" not in out.columns:
        return best
    # a query has one number of hops in each shard, on every row of it
    hops = out.groupBy("qid", "hops", "compared").agg(F.lit(1).alias("one")).groupBy("qid").agg(F.sum("hops").alias("hops"))
    return best.join(hops, "qid")


#: Of an exact graph: blocks of points that a task holds as queries, and groups a side that a small table, too, is dealt to.
BLOCKS_HELD, LEAST_GROUPS = 16, 8


def knn_graph(points: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(src, pos, dst, dist): the exact k-nearest-neighbour graph.

    Points are cut into blocks by hash, a row each, and blocks are dealt to groups. A task holds the points of one group, reads the blocks
    of another, compares each pair once and keeps the best k of both: work grows with the square of the points, as it must for an exact
    graph, but no task holds more than one group and a block, and the driver none.
    """
    n = points.count()
    parts = max(1, -(-n // block))
    groups = max(-(-parts // BLOCKS_HELD), min(parts, LEAST_GROUPS))
    named = points.where("vec is not null and id is not null").select(F.col("id").cast("long").alias("id"), "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))

    def pack(table: pa.Table) -> pa.Table:
        x = knn.matrix(table.column("vec"))
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        return pa.table({"part": table.column("part").slice(0, 1), "dims": pa.array([x.shape[1]], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vecs": pa.array([x[order].tobytes()], pa.binary())})

    blocks = persisted(named.groupBy("part").applyInArrow(pack, "part int, dims int, ids binary, vecs binary")).withColumn("group", F.col("part") % groups)
    # a task for each two groups, the one with the smaller number held
    cell = F.col("low") * groups + F.col("high") - F.expr("low * (low + 1) div 2")
    columns = ["cell", "side", "part", "dims", "ids", "vecs"]
    held = blocks.withColumn("low", F.col("group")).withColumn("high", F.explode(F.sequence("group", F.lit(groups - 1)))).withColumn("side", F.lit(0))
    read = blocks.withColumn("high", F.col("group")).withColumn("low", F.explode(F.sequence(F.lit(0), "group"))).withColumn("side", F.lit(1))
    both = held.withColumn("cell", cell).select(*columns).unionByName(read.withColumn("cell", cell).select(*columns))
    dealt = both.repartitionById(groups * (groups + 1) // 2, F.col("cell").cast("int")).sortWithinPartitions("cell", "side", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = -1, [], None
        for batch in batches:
            for at in range(batch.num_rows):
                now, side, part, dims, ids, vecs = (batch.column(c)[at].as_py() for c in columns)
                if now != cell:
                    if best is not None:
                        yield from found(best)
                    cell, held, best = now, [], None
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.float64).reshape(-1, dims)
                if side == 0:
                    held.append((part, ids, x))
                    continue
                if best is None:
                    best = [(p, own, knn.Rows(q, "l2", True), knn.Best(len(own), k)) for p, own, q in held]
                    held = []
                # two blocks of one group meet when the later one is read; all rows of an id are in one block
                group = {p for p, *_ in best}
                for some in (slice(i, i + knn.ROWS_AT_ONCE) for i in range(0, len(ids), knn.ROWS_AT_ONCE)):
                    base, back = knn.Rows(x[some], "l2"), knn.Best(len(ids[some]), k)
                    for p, own, queries, kept in best:
                        if part not in group or p <= part:
                            kept.meet(own, queries, ids[some], base, None if p == part else back, p == part)
                    yield from found([(part, ids[some], base, back)])
        if best is not None:
            yield from found(best)

    def found(best: list) -> Iterator[pa.RecordBatch]:
        for _, own, _, kept in best:
            out = kept.batch(own)
            yield pa.RecordBatch.from_arrays(out.columns, ["src", "dst", "dist"])

    pairs = dealt.mapInArrow(run, "src long, dst long, dist double")
    best = knn.ranked(pairs.select(F.col("src").alias("qid"), F.col("dst").alias("id"), "dist"), k)
    return best.select(F.col("qid").alias("src"), F.col("rank").alias("pos"), F.col("id").alias("dst"), "dist")


def degrees(edges: DataFrame) -> DataFrame:
    """One row: nodes, largest, smallest and mean degree, nodes of under two neighbours."""
    n = F.size("nbrs")
    return edges.agg(F.count(F.lit(1)).alias("nodes"), F.max(n).alias("largest"), F.min(n).alias("smallest"), F.avg(n).alias("average"), F.sum((n < 2).cast("long")).alias("under_two"))


def bfs_levels(pairs: DataFrame, start: int, most: int = 32) -> DataFrame:
    """(level, n) from (src, dst): nodes first reached at each level. The frontier and the visited nodes are written tables."""
    spark = pairs.sparkSession
    visited = spark.createDataFrame([(start, 0)], "node long, level int")
    frontier = visited
    for level in range(1, most + 1):
        reached = frontier.join(pairs, frontier["node"] == pairs["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = persisted(reached.join(visited, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def stitched(pairs: DataFrame) -> DataFrame:
    """(src, nbrs) of (src, dst) edges of several graphs: each ordered pair once, neighbours by id."""
    return pairs.where("src <> dst").select("src", "dst").distinct().groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def merged_shards(edges: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """(src, nbrs) of overlapping shards' (src, nbrs): the union of a node's lists in seeded order, at most ``most``."""
    pairs = edges.select("src", F.explode("nbrs").alias("dst")).distinct()
    ordered = pairs.groupBy("src").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "src", "dst").alias("h"), "dst"))).alias("all"))
    return ordered.select("src", F.slice(F.transform("all", lambda s: s["dst"]), 1, most).alias("nbrs"))


def build_merged(sharded: DataFrame, degree: int = 32, width: int = 64, alpha: float = ALPHA, metric: str = "l2", seed: int = 1) -> DataFrame:
    """(src, nbrs): one graph over overlapping shards (shard, id, vec): each is built with two thirds of the degree, then lists are united."""
    return merged_shards(build(sharded, max(1, 2 * degree // 3), width, alpha, metric), degree, seed)


def pruned(edges: DataFrame, points: DataFrame, degree: int, alpha: float = ALPHA, metric: str = "l2", by: list[str] | None = None) -> DataFrame:
    """(src, nbrs): nodes above ``degree`` pruned to it; others as they are. Candidate vectors are joined, no node needs all vectors.

    ``by``: further columns of both sides, such as the shard, that are part of a node's name.
    """
    by = by or []
    few = edges.where(F.size("nbrs") <= degree).select(*by, "src", "nbrs")
    many = edges.where(F.size("nbrs") > degree)
    others = many.select(*by, "src", F.explode("nbrs").alias("id")).join(points.select(*by, "id", "vec"), [*by, "id"])
    own = many.select(*by, "src", F.col("src").alias("id")).join(points.select(*by, "id", "vec"), [*by, "id"])

    pools = others.select(*by, "src", "id", "vec").unionByName(own.select(*by, "src", "id", "vec")).groupBy(*by, "src").agg(F.collect_list(F.struct("id", "vec")).alias("pool"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pool, nbrs = batch.column("pool"), []
            for at, src in enumerate(batch.column("src").to_pylist()):
                one = pool.slice(at, 1).flatten()
                ids, first = np.unique(one.field("id").to_numpy(), return_index=True)
                x = knn.matrix(one.field("vec"))[first]
                kept = robust_prune(x, int(np.searchsorted(ids, src)), list(range(len(ids))), degree, alpha, metric=metric)
                nbrs.append(ids[kept].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "src")), pa.array(nbrs, pa.list_(pa.int64()))], [*by, "src", "nbrs"])

    schema = "".join(f"{c} {points.schema[c].dataType.simpleString()}, " for c in by) + "src long, nbrs array<long>"
    return few.unionByName(pools.mapInArrow(run, schema))


def repaired(edges: DataFrame, deleted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(src, nbrs) after deletions: deleted neighbours are replaced by theirs, without deleted nodes, the node itself or doubles.

    ``by``: further columns, such as the shard, that are part of a node's name.
    """
    by = by or []
    gone = deleted.select("id").distinct()
    live = edges.select(*by, "src", "nbrs").join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    pairs = live.select(*by, "src", F.explode("nbrs").alias("dst"))
    lost = pairs.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")
    theirs = lost.join(edges.select(*by, F.col("src").alias("dst"), F.col("nbrs").alias("next")), [*by, "dst"]).select(*by, "src", F.explode("next").alias("dst"))
    every = pairs.unionByName(theirs).where("src <> dst").distinct().join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    lists = every.groupBy(*by, "src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
    return live.select(*by, "src").join(lists, [*by, "src"], "left").select(*by, "src", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def compacted(edges: DataFrame) -> DataFrame:
    """(src, nbrs, old): live nodes numbered densely in order of their ids, dangling edges dropped. Numbering is by range partitions."""
    numbered = dense_numbers(edges.select(F.col("src").alias("old")))
    pairs = edges.select(F.col("src").alias("old"), F.posexplode("nbrs").alias("pos", "dst"))
    dst = numbered.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    lists = pairs.join(dst, "dst").groupBy("old").agg(F.array_sort(F.collect_list(F.struct("pos", "new_dst"))).alias("all"))
    return numbered.join(lists, "old", "left").select(F.col("new").alias("src"), F.coalesce(F.transform("all", lambda s: s["new_dst"]), F.array().cast("array<bigint>")).alias("nbrs"), "old")


def dense_numbers(ids: DataFrame) -> DataFrame:
    """(old, new): ranks from 0 in order of ``old``, by range partitions and their offsets instead of one window over all rows."""
    from pyspark.sql import Window

    ordered = persisted(ids.repartitionByRange("old").withColumn("part", F.spark_partition_id()))
    offset, at = {}, 0
    for part, n in sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect()):
        offset[part], at = at, at + n
    starts = F.create_map(*[F.lit(v) for pair in offset.items() for v in pair]) if offset else F.create_map(F.lit(0), F.lit(0))
    return ordered.select("old", (F.row_number().over(Window.partitionBy("part").orderBy("old")) - 1 + starts[F.col("part")]).cast("long").alias("new"))


def free_slots(used: DataFrame, capacity: int) -> DataFrame:
    """(slot): places from 0 to ``capacity`` that no id of (id) takes, in which points may be put."""
    return used.sparkSession.range(capacity).withColumnRenamed("id", "slot").join(used.select(F.col("id").alias("slot")).distinct(), "slot", "left_anti")


def stitched_starts(points: DataFrame) -> DataFrame:
    """(label, id): a start node of each label of (id, vec, labels): of its points the nearest to their mean."""
    from ..functions import vectors

    owner = points.select("id", "vec", F.explode(F.array_distinct("labels")).alias("label"))
    means = owner.select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"))
    near = owner.join(centre, "label").select("label", F.struct(vectors.l2(F.col("vec"), F.col("centre")).alias("dist"), F.col("id")).alias("near"))
    return near.groupBy("label").agg(F.min("near").alias("near")).select("label", F.col("near.id").alias("id"))


def expand(frontier: DataFrame, pairs: DataFrame, visited: DataFrame) -> DataFrame:
    """(qid, node): the neighbours of a frontier (qid, node) over (src, dst) that their query has not visited (qid, node)."""
    reached = frontier.join(pairs, frontier["node"] == pairs["src"]).select("qid", F.col("dst").alias("node")).distinct()
    return reached.join(visited.select("qid", "node"), ["qid", "node"], "left_anti")


def reversed_edges(pairs: DataFrame) -> DataFrame:
    """(src, nbrs): for each node the sources of its incoming edges, by id."""
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))

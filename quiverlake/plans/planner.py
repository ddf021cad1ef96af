"""Budgets: pure functions from memory and page sizes to degrees, page sizes and cache shares."""

from __future__ import annotations

from math import ceil, floor

#: Fixed values of the format and the planner.
PAGE_BYTES = 4096
ID_BYTES = 4
HEADER_BYTES = 4
RESERVED_MB = 60
STEPS = 1000
ARRAY_FROM = 0.25
ROUND_UP_FROM = 0.9
MOST_CHUNKS = 512
GB = 1 << 30


def nodes_per_page(dim: int, bytes_per_value: int, page_degree: int, pq_bytes: int, cached_share: float) -> int:
    """Vectors that fit a page beside its neighbour ids and the codes of those that are not cached."""
    cached = int(page_degree * cached_share)
    taken = HEADER_BYTES + ID_BYTES * page_degree + pq_bytes * (page_degree - cached)
    return max(0, PAGE_BYTES - taken) // (dim * bytes_per_value)


def page_layout(dim: int, bytes_per_value: int, pq_bytes: int, cached_share: float, least_degree: int) -> tuple[int, int]:
    """(page degree, nodes a page): as many nodes as leave each ``least_degree`` neighbours, then all the neighbours that still fit."""
    fit = lambda degree: nodes_per_page(dim, bytes_per_value, degree, pq_bytes, cached_share)
    degree = next(d for d in range(least_degree, PAGE_BYTES) if fit(d) == 0 or d >= least_degree * fit(d))
    nodes = fit(degree)
    if not nodes:
        return 0, 0
    more = next(d for d in range(degree + 1, PAGE_BYTES + 1) if fit(d) != nodes)
    return more - 1, nodes


def spare_bytes(dim: int, bytes_per_value: int, page_degree: int, nodes: int, pq_bytes: int, cached_share: float) -> int:
    """Bytes of a page that its header, vectors, neighbour ids and the codes of uncached neighbours leave."""
    cached = int(page_degree * cached_share)
    return max(0, PAGE_BYTES - HEADER_BYTES - nodes * dim * bytes_per_value - ID_BYTES * page_degree - pq_bytes * (page_degree - cached))


def recommended_degree(dim: int, bytes_per_value: int, pq_bytes: int, cached_share: float, least_degree: int) -> int:
    """The graph degree to build with: neighbours a node of the page layout, rounded up from ROUND_UP_FROM on."""
    degree, nodes = page_layout(dim, bytes_per_value, pq_bytes, cached_share, least_degree)
    if not nodes:
        return 0
    whole, part = divmod(degree, nodes)
    return whole + (part / nodes >= ROUND_UP_FROM)


def index_bytes(cached: int, points: int, share: float) -> int:
    """Bytes of the map from cached nodes to codes: an array over all points, or a sparse map at load factor two."""
    return ID_BYTES * points if share >= ARRAY_FROM else 4 * ID_BYTES * cached


def cache_shares(budget_gb: float, pq_bytes: int, points: int) -> tuple[float, float]:
    """(share of points with hash routing, share with cached codes). Codes go first; only when all fit does the rest go to routing.

    (-1, -1) below the reserved memory. Memory grows with the share, so the last affordable of STEPS steps is found by bisection
    on each side of the change from a map to an array.
    """
    spare = (budget_gb * 1024 - RESERVED_MB) * (1 << 20)
    if spare < 0:
        return -1.0, -1.0
    full = pq_bytes * points
    if spare >= full:
        return min(points, int((spare - full) / (2 * ID_BYTES))) / points, 1.0

    def needed(step: int) -> int:
        cached = int(step / STEPS * points)
        index = index_bytes(cached, points, step / STEPS)
        return full if (points - cached) * pq_bytes <= index else cached * pq_bytes + index

    last = 0
    for step in range(STEPS + 1):
        if needed(step) > spare:
            break
        last = step
    return 0.0, last / STEPS


def cache_plan(cached: int, points: int, chunks: int) -> str:
    """How the codes are kept: all (what is left is no larger than the map), or those cached with an array or a map."""
    share = cached / points
    if (points - cached) * chunks <= index_bytes(cached, points, share):
        return "all"
    return "array" if share >= ARRAY_FROM else "map"


def pq_chunks(budget_gb: float, points: int, dim: int) -> int:
    """Code bytes a point: the budget (a quarter GB less where over 1 GB is left) over the points, between 1 and the dimensions."""
    usable = budget_gb - 0.25 if budget_gb - 0.25 > 1 else budget_gb
    return max(1, min(floor(usable * GB / points), dim, MOST_CHUNKS))


def build_memory_gb(points: int, dim: int, bytes_per_value: int, degree: int) -> float:
    """Memory of building a graph in one piece, with the slack of degrees and a tenth on top."""
    aligned = 8 * ceil(dim / 8)
    return 1.1 * points * (aligned * bytes_per_value + ID_BYTES * degree * 1.3) / GB


def chunk_offsets(dim: int, chunks: int) -> list[int]:
    """Offsets of the chunks of a vector: the first ``dim % chunks`` have one dimension more."""
    low, more = divmod(dim, chunks)
    out = [0]
    for i in range(chunks):
        out.append(out[-1] + low + (i < more))
    return out

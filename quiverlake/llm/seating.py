"""Seating of Chinese restaurants with discounts, for the hierarchical Pitman-Yor model of ``pitman_yor``.

A dish with c customers sits at t tables. Given all other tables of its restaurant (``rest``), the strength, the discount d and the
parent's probability of the dish (``base``), the customers are taken away and seated anew: the number of their tables has the weights

    S_d(c, t) * prod over i < t of (strength + d * (rest + i)) * base,        t = 1 ... c,

where S_d(c, t), the sum over all seatings of c customers at t tables, follows S_d(n + 1, t) = S_d(n, t - 1) + (n - d t) S_d(n, t). So a draw
is an exact Gibbs step over all customers of a dish at once; which customer sits where does not matter to any probability.

The rows S_d(n, .) are exact up to EXACT customers. Beyond, the same distribution is evaluated numerically: at the points of a geometric
grid, to which rows are carried on by blocks of customers, if few tables are expected, and else by its saddle point, a normal
distribution around t* = w (1 - (1 - x)^d) / d, where c = w x (1 - x)^(d - 1) and w is the weight of a new table (``tests/llm``
compares both with exact rows). Uniform numbers are hashes of a key, so draws do not depend on partitions or order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .bytekit import BASE, mix

#: Customers up to which rows are exact; blocks beyond (one in so many of the customers), their width and most new tables of a block.
EXACT = 4096
GRID = 64
WIDTH = 512
STEPS = 8
#: Expected tables from which the saddle point is used beyond EXACT customers, and values held at once.
MANY = 64.0
VALUES = 1 << 21


def uniform(key: np.ndarray, number: int) -> np.ndarray:
    """A number in (0, 1) for each key and ``number``."""
    h = mix(mix(key + np.uint64((number + 1) * int(BASE) % (1 << 64))))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of some hundreds and more."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x)


def grid(c: np.ndarray) -> np.ndarray:
    """The number of customers whose row is used: c itself up to EXACT, beyond it a near point of the grid."""
    k = np.rint(np.log(np.maximum(c, EXACT) / EXACT) * GRID)
    return np.where(c <= EXACT, c, np.rint(EXACT * np.exp(k / GRID))).astype(np.int64)


def rows(d: float, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, log S_d(n, t) for t = 1, 2, ...) for ascending points n of ``grid``."""
    n, row, at = 1, np.zeros(1), 0
    wanted = wanted.tolist()
    while at < len(wanted):
        if wanted[at] == n:
            yield n, row
            at += 1
            continue
        if n < EXACT:
            t = np.arange(1, n + 1)
            stay = np.append(row + np.log(n - d * t), -np.inf)
            row = np.logaddexp(stay, np.concatenate(([-np.inf], row)))
            n += 1
        else:
            k = round(np.log(n / EXACT) * GRID) + 1
            more = int(np.rint(EXACT * np.exp(k / GRID)))
            row = row[:WIDTH]
            t = np.arange(1, len(row) + 1)
            opened = np.log(more - d * t) - np.log(n - d * t)
            new, term = row.copy(), np.zeros(len(row))
            for j in range(1, STEPS):
                # j tables opened in the block: half of its customers, on average, came before
                term = term + np.log(opened / j) + d * opened / 2
                new[j:] = np.logaddexp(new[j:], row[:-j] + term[j:])
            row = new + _log_gamma(more - d * t) - _log_gamma(n - d * t)
            n = more


def saddle(c: np.ndarray, weight: np.ndarray, slope: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of t for many customers; a new table's weight is ``weight`` + ``slope`` * t."""

    def mode(w: np.ndarray) -> np.ndarray:
        # log of 1 - x by bisection: w x (1 - x)^(d - 1) grows with x
        low, high = np.full(len(c), -80.0), np.full(len(c), -1e-9)
        for _ in range(60):
            mid = (low + high) / 2
            few = np.log(w) + np.log(-np.expm1(mid)) + (d - 1) * mid < np.log(c)
            low, high = np.where(few, low, mid), np.where(few, mid, high)
        return w * -np.expm1(d * (low + high) / 2) / d

    t = np.ones(len(c))
    for _ in range(40):
        t = np.clip((t + mode(weight + slope * t)) / 2, 1, c)
    w = weight + slope * t
    spread = (mode(w * 1.01) - mode(w / 1.01)) / (2 * np.log(1.01))
    return t, 1 / np.maximum(1 / np.maximum(spread, 1e-9) - slope / w, 1e-9)


def tables(c: np.ndarray, rest: np.ndarray, base: np.ndarray, strength: float, d: float, key: np.ndarray, number: int = 0) -> np.ndarray:
    """The tables of each dish, drawn given the rest. No customers have no table, one has one."""
    out = (c > 0).astype(np.int64)
    several = np.flatnonzero(c > 1)
    if not len(several):
        return out
    u = uniform(key[several], number)
    c, first, slope = c[several], (strength + d * rest[several]) * base[several], d * base[several]
    t = np.ones(len(c), np.int64)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        mean, variance = saddle(c[big], first[big], slope[big], d)
        many = mean >= MANY
        big, mean, variance = big[many], mean[many], variance[many]
        normal = np.sqrt(-2 * np.log(u[big])) * np.cos(2 * np.pi * uniform(key[several][big], number + (1 << 20)))
        t[big] = np.clip(np.rint(mean + np.sqrt(variance) * normal), 1, c[big])
    point = grid(c)
    point[big] = 0
    order = np.argsort(point, kind="stable")
    order = order[point[order] > 0]
    distinct, at = np.unique(point[order], return_index=True)
    bounds = np.append(at, len(order)).tolist()
    for k, (_, row) in enumerate(rows(d, distinct)):
        low, high = bounds[k], bounds[k + 1]
        step = max(1, VALUES // len(row))
        for a in range(low, high, step):
            some = order[a : min(high, a + step)]
            log = row + np.cumsum(np.log(first[some, None] + slope[some, None] * np.arange(len(row))), axis=1)
            total = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            t[some] = (total < u[some, None] * total[:, -1:]).sum(axis=1) + 1
    out[several] = t
    return out

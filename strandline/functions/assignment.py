"""Assignment of rows to columns at least total cost, where leaving a row or column alone costs half the limit."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Matched pairs, unmatched rows, unmatched columns. A pair is taken only where it beats leaving both alone.

    Pairs that cost the limit or more are never taken, so rows and columns with one possible partner each are settled at
    once and only the rest, few in practice, goes through the matching.
    """
    n, m = cost.shape
    if not n or not m:
        return [], list(range(n)), list(range(m))
    possible = cost < limit
    sole = possible & (possible.sum(1) == 1)[:, None] & (possible.sum(0) == 1)[None]
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(sole))]
    rest = possible & ~sole
    r, c = np.flatnonzero(rest.any(1)), np.flatnonzero(rest.any(0))
    if len(r):
        size = len(r) + len(c)
        full = np.full((size, size), limit / 2.0)
        full[len(r) :, len(c) :] = 0.0
        full[: len(r), : len(c)] = cost[np.ix_(r, c)]
        to = shortest_paths(full)
        pairs += [(int(r[i]), int(c[to[i]])) for i in range(len(r)) if to[i] < len(c) and rest[r[i], c[to[i]]]]
    pairs.sort()
    rows, cols = {i for i, _ in pairs}, {j for _, j in pairs}
    return pairs, [i for i in range(n) if i not in rows], [j for j in range(m) if j not in cols]


def shortest_paths(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost perfect matching of a square matrix, by successive shortest augmenting paths."""
    n = len(cost)
    u, v = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        reach = np.full(n, np.inf)
        back = np.full(n, -1)
        done = np.zeros(n, bool)
        i, base, last = start, 0.0, -1
        path_rows = [start]
        while True:
            slack = base + cost[i] - u[i] - v
            better = ~done & (slack < reach)
            reach[better] = slack[better]
            back[better] = last
            j = int(np.argmin(np.where(done, np.inf, reach)))
            base = reach[j]
            done[j] = True
            if row_of[j] < 0:
                break
            last, i = j, int(row_of[j])
            path_rows.append(i)
        u[start] += base
        for c in np.flatnonzero(done):
            if c != j:
                u[row_of[c]] += base - reach[c]
            v[c] -= base - reach[c]
        while j >= 0:
            p = int(back[j])
            row_of[j] = row_of[p] if p >= 0 else start
            j = p
    out = np.empty(n, np.int64)
    out[row_of] = np.arange(n)
    return out

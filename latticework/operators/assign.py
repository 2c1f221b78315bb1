"""Assignment kernels on small matrices (numpy only)."""

from __future__ import annotations

from itertools import combinations, permutations
from math import comb, factorial

import numpy as np


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Columns of a least-cost assignment of all rows (rows <= columns), by shortest augmenting paths.

    Ties go to the smallest column in each search, so equal input gives equal output.
    """
    cost = np.asarray(cost, float)
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0] = i
        at, least, used = 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while row_of[at]:
            used[at] = True
            gap = cost[row_of[at] - 1] - u[row_of[at]] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better] = gap[better]
            way[1:][better] = at
            open_ = np.where(used[1:], np.inf, least[1:])
            nxt = int(np.argmin(open_)) + 1
            step = open_[nxt - 1]
            u[row_of[used]] += step
            v[used] -= step
            least[1:][~used[1:]] -= step
            at = nxt
        while at:
            row_of[at] = row_of[way[at]]
            at = way[at]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def supercell(cost: np.ndarray, k: int) -> list[list[int]]:
    """k columns for each row, by k rounds of least-cost assignment over the columns left; rows get fewer when columns run out."""
    n, m = cost.shape
    out: list[list[int]] = [[] for _ in range(n)]
    left = list(range(m))
    for _ in range(k):
        if not left:
            break
        sub = cost[:, left]
        if n <= len(left):
            picked = list(enumerate(hungarian(sub).tolist()))
        else:
            picked = [(int(r), c) for c, r in enumerate(hungarian(sub.T).tolist())]
        for r, c in picked:
            out[r].append(left[c])
        left = [c for i, c in enumerate(left) if i not in {c for _, c in picked}]
    return out


def count_assignments(n: int, k: int) -> int:
    """Ways to deal n k columns to n rows, k each."""
    out = 1
    for i in range(n):
        out *= comb((n - i) * k, k)
    return out if k > 1 else factorial(n)


def assignments(rows: list[int], columns: list[int], k: int):
    """All ways to deal the columns to the rows, k each, in order."""
    if not rows:
        yield {}
        return
    for own in combinations(columns, k):
        rest = [c for c in columns if c not in own]
        for tail in assignments(rows[1:], rest, k):
            yield {rows[0]: own} | tail


def bijections(left: list, right: list):
    for p in permutations(right):
        yield dict(zip(left, p))


def swap_refine(cost_of, columns: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Two-exchange: swaps of two rows' columns that lower cost_of(columns), the first that does, round by round."""
    columns, best = columns.copy(), cost_of(columns)
    for _ in range(rounds):
        better = False
        for i, j in combinations(range(len(columns)), 2):
            trial = columns.copy()
            trial[i], trial[j] = trial[j], trial[i]
            c = cost_of(trial)
            if c < best - 1e-12:
                columns, best, better = trial, c, True
                break
        if not better:
            break
    return columns

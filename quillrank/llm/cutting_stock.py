"""Cutting stock by column generation: which combinations of piece lengths fill sequences, and how often.

The linear program has one row per length class and one column per pattern.
Columns are made as they are needed: the dual prices of the classes are the
values of a knapsack, and its dynamic program finds the pattern of most value;
while that is over one, the pattern enters the basis.  Fractional counts are
rounded down, what stays open is packed best fit decreasing.  Everything here
is over classes, so its size doesn't depend on how many documents there are.
"""

from __future__ import annotations

import numpy as np


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity; ``sizes`` ascending."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - sizes[:k]] + values[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], choice[c] = gain[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 2e-4, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns of the linear program's basis and how often each is used.

    Stops at the optimum, or when the bound from the best column's value is
    within ``tolerance`` of the present number of sequences or within half a
    sequence, or after ``rounds`` columns (any basis is a valid packing).
    """
    m = len(sizes)
    each = capacity // sizes
    inverse = np.diag(1.0 / each)
    columns: list[np.ndarray] = [np.eye(m, dtype=np.int64)[i] * each[i] for i in range(m)]
    cost, x = np.ones(m), demand / each
    for _ in range(rounds):
        prices = cost @ inverse
        if (low := int(np.argmin(prices))) >= 0 and prices[low] < -1e-9:
            column, price = -np.eye(m, dtype=np.int64)[low], 0.0  # more than asked for of one class
        else:
            value, column = knapsack(sizes, prices, capacity)
            total = float(cost @ x)
            if value <= 1 + 1e-9 or total - total / value <= max(0.5, tolerance * total):
                break
            price = 1.0
        move = inverse @ column
        up = move > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = np.maximum(x - step * move, 0)
        x[r] = step
        row = inverse[r] / move[r]
        inverse -= np.outer(move, row)
        inverse[r] = row
        columns[r], cost[r] = column, price
    return [(columns[i], float(x[i])) for i in range(m) if cost[i] > 0 and x[i] > 1e-9]


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that use exactly ``demand`` of each class."""
    if not len(sizes):
        return []
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        if times > 0 and pattern.any():
            left[:] -= pattern * times
            out.append((pattern, times))

    basis = column_generation(sizes, demand.astype(float), capacity)
    for pattern, x in basis:
        times = int(x + 1e-6)
        while times > 0:  # where the basis has more of a class than there is, the class goes from the pattern
            now = np.minimum(pattern, left)
            if not (on := now > 0).any():
                break
            n = min(times, int((left[on] // now[on]).min()))
            use(now, n)
            times -= n
    for pattern, x in sorted(basis, key=lambda b: -(b[1] % 1)):
        if x % 1 > 1e-6 and (left >= pattern).all():
            use(pattern, 1)
    bins: list[np.ndarray] = []
    room: list[int] = []
    for i in range(len(sizes) - 1, -1, -1):  # what rounding left: few pieces of each class
        for _ in range(int(left[i])):
            fit = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            if fit:
                r, b = min(fit)
            else:
                b = len(bins)
                bins.append(np.zeros(len(sizes), np.int64))
                room.append(capacity)
            bins[b][i] += 1
            room[b] -= int(sizes[i])
    out += [(b, 1) for b in bins]
    return out

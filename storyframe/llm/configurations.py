"""How to fill bins from a histogram of lengths: a configuration linear program, solved by multiplicative weights.

A configuration is a multiset of lengths that fits a bin.  The program covers every length's demand by as few
configurations as possible.  Each round prices the lengths, finds by dynamic programming over the capacity (an unbounded
knapsack) the most valuable configuration that holds each length, spreads mass over those near the best value, and then
raises the price of lengths that were covered too little and lowers the others'.  The masses of all rounds are rounded:
a configuration is used as often as its mass says and what is left of its lengths allows, so nothing is covered twice;
what remains is a smaller program, solved again, and in the end packed best fit, the longest first.

All of it works on the histogram, whose size the capacity bounds; how many pieces there are doesn't matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import pairwise

import numpy as np


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity from 0, and the length taken last there (0: one unit stays empty)."""
    value, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        found = price[c:0:-1] + value[:c]
        k = int(found.argmax())  # of equals the longest, so that short pieces are left for what comes later
        if found[k] > value[c - 1]:
            value[c], taken[c] = found[k], c - k
        else:
            value[c] = value[c - 1]
    return value, taken


def columns(seeds: np.ndarray, taken: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed's number, length, how often) of the best configuration that holds each seed."""
    # Room that stays empty is skipped at once.
    use = np.where(taken > 0, np.arange(capacity + 1), 0)
    use = np.maximum.accumulate(use)
    row, length = [np.arange(len(seeds))], [seeds]
    active, room = np.arange(len(seeds)), use[capacity - seeds]
    while (keep := room > 0).any():
        active, room = active[keep], room[keep]
        row.append(active)
        length.append(taken[room])
        room = use[room - taken[room]]
    key, many = np.unique(np.concatenate(row) * (capacity + 1) + np.concatenate(length), return_counts=True)
    return key // (capacity + 1), key % (capacity + 1), many


def solve(demand: np.ndarray, rounds: int = 16, near: float = 0.05, step: float = 0.5) -> tuple[list[tuple[float, tuple]], float]:
    """Masses of configurations, each ((length, how often), ...), and a lower bound of the program's value.

    demand: pieces by length, from length 0 (unused) to the capacity.  Configurations count whose value is within the
    share ``near`` of the best; ``step`` is the first round's largest change of a price, later ones are smaller.
    """
    capacity = len(demand) - 1
    if not demand.any():
        return [], 0.0
    seeds = np.flatnonzero(demand)
    need = demand[seeds].astype(float)
    least = float((seeds * need).sum()) / capacity
    price = np.full(capacity + 1, -np.inf)
    price[seeds] = seeds / capacity
    mass: dict[tuple, float] = {}
    bound = 0.0
    for k in range(rounds):
        value, taken = knapsack(price, capacity)
        held = price[seeds] + value[capacity - seeds]
        bound = max(bound, float((price[seeds] * need).sum() / held.max()))
        good = np.flatnonzero(held >= (1 - near) * held.max())
        row, length, many = columns(seeds[good], taken, capacity)
        own = np.zeros(len(good))
        own[row[length == seeds[good][row]]] = many[length == seeds[good][row]]
        part = need[good] / own
        part *= max(bound, least) / part.sum()
        covered = np.bincount(length, part[row] * many, capacity + 1)[seeds] / need
        price[seeds] *= np.exp(-step / (1 + k / 2) * np.clip(covered - 1, -1, 1))
        edges = np.r_[np.searchsorted(row, np.arange(len(good))), len(row)].tolist()
        pairs = list(zip(length.tolist(), many.tolist()))
        for own_part, (a, b) in zip(part.tolist(), pairwise(edges)):
            column = tuple(pairs[a:b])
            mass[column] = mass.get(column, 0.0) + own_part / rounds
    return [(m, c) for c, m in mass.items()], bound


def best_fit(demand: np.ndarray) -> list[tuple[int, tuple]]:
    """Best fit of all pieces, the longest first: (bins, ((length, how often), ...)).  Equal bins are one group."""
    capacity = len(demand) - 1
    groups: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, bins: int, held: tuple) -> None:
        if bins:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((bins, held))

    for length in np.flatnonzero(demand)[::-1].tolist():
        left = int(demand[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, (bins, held) = capacity, (-(-left // (capacity // length)), ())
            else:
                room = rooms[at]
                bins, held = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // length
            full = min(bins, left // each)
            rest = min(left - full * each, each) if bins > full else 0
            put(room - each * length, full, (*held, (length, each)))
            if rest:
                put(room - rest * length, 1, (*held, (length, rest)))
            put(room, bins - full - bool(rest), held)
            left -= full * each + rest
    return [g for found in groups.values() for g in found]


def plan(demand: np.ndarray, stages: int = 8, rounds: int = 16) -> list[tuple[int, tuple]]:
    """(bins, ((length, how often), ...)) that hold every piece once: the program, rounded, stage by stage, then best fit.

    A full configuration is rounded up, one with room down; the fullest come first.  Stages end when one places less than
    a fiftieth of what is left.
    """
    left = demand.astype(np.int64).copy()
    capacity = len(left) - 1
    out: list[tuple[int, tuple]] = []
    if left[capacity]:
        out.append((int(left[capacity]), ((capacity, 1),)))
        left[capacity] = 0
    for _ in range(stages):
        if not left.any():
            break
        before = int(left.sum())
        masses, _ = solve(left, rounds)
        for m, column in sorted(masses, key=lambda x: (-sum(a * b for a, b in x[1]), -x[0], x[1])):
            full = sum(a * b for a, b in column) == capacity
            uses = min(int(-(-m // 1)) if full else int(m), min(int(left[a]) // b for a, b in column))
            if uses:
                out.append((uses, column))
                for a, b in column:
                    left[a] -= uses * b
        if before - int(left.sum()) < before // 50:
            break
    return out + best_fit(left)

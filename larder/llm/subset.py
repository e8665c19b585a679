"""Subset sums over size multiplicities, with bitsets."""

from __future__ import annotations

import math
import random

import numpy as np


def proportional_subset(counts: dict[int, int], target: int, *, seed: int = 0, below_only: bool = False) -> dict[int, int]:
    """How many items of each size to take so that the subset resembles the whole and its total is near target.

    From the largest size down, each size gives its share of what is still wanted of what
    is still left, rounded up or down by a seeded draw, so that rare sizes have their
    share too; smaller sizes make up for the rounding of larger ones.
    """
    draw = random.Random(seed)
    whole, rest, taken = sum(s * c for s, c in counts.items()), target, {}
    for size in sorted(counts, reverse=True):
        c = counts[size]
        last = whole == size * c  # what is left is of this size only
        k = rest // size if last else math.floor(c * max(rest, 0) / whole + draw.random())
        k = max(0, min(k, c, rest // size if below_only else c))
        taken[size] = k
        rest -= k * size
        whole -= c * size
    return taken


def closest_subset(counts: dict[int, int], target: int, *, seed: int = 0, below_only: bool = False) -> dict[int, int]:
    """How many items of each size to take so that their total is the closest to target of all subsets.

    counts: items by size (> 0).  Ties go to the smaller total; with ``below_only`` the
    total never exceeds the target.  Begun with ``proportional_subset``.  Where that
    misses the target, up to ``depth`` items of each of the smallest sizes may be given
    back and as many added, which a bitset of totals settles exactly; depth and number of
    sizes are doubled until the total is met or nothing further can help.  That is so at
    all sizes and twice the largest size (or four times the miss): the exchanges that
    lead to a best subset, put in an order that keeps the running sum near zero, would
    else come to one sum twice, and those between could be left out.  After a miss this
    takes two bytes for each unit that may be given back.
    """
    # a size beyond twice the target (beyond it, with below_only) is worse than nothing
    counts = {s: c for s, c in counts.items() if 0 < s <= (1 if below_only else 2) * target and c > 0}
    if not counts:
        return {}
    goal, unit = max(0, min(target, sum(s * c for s, c in counts.items()))), math.gcd(*counts)
    taken = proportional_subset(counts, goal, seed=seed, below_only=below_only)
    best_key = (goal % unit, False) if below_only else min((goal % unit, False), (-goal % unit, True))
    miss = goal - sum(s * k for s, k in taken.items())
    order = sorted(counts)
    enough = min(max(counts.values()), 2 * max(order[-1], 2 * abs(miss)) // unit + 1)
    depth, some = 1, min(8, len(order))
    while (abs(miss), miss < 0) > best_key:
        near = order[:some]
        base = {s: max(0, taken[s] - depth) for s in near}
        step = math.gcd(*near)
        free = {s // step: min(counts[s], taken[s] + depth) - base[s] for s in near}
        rest = miss + sum(s * (taken[s] - base[s]) for s in near)
        if rest >= 0:
            add = _closest_sum(free, rest, step, rest if below_only else rest + abs(miss))
            left = rest - sum(s * k * step for s, k in add.items())
            if (abs(left), left < 0) < (abs(miss), miss < 0):
                taken |= {s: k + add.get(s // step, 0) for s, k in base.items()}
                miss = left
        if depth >= enough and some >= len(order):
            break
        depth, some = min(2 * depth, enough), min(2 * some, len(order))
    return {s: k for s, k in taken.items() if k}


def _closest_sum(counts: dict[int, int], rest: int, unit: int, most: int) -> dict[int, int]:
    """How many of each size give the sum that, times unit, is closest to rest and at most ``most``; of two the smaller."""
    limit, low = most // unit, rest // unit
    if math.prod(c + 1 for c in counts.values()) <= 1 << 16:
        return _closest_of_few(counts, rest, unit, limit)
    want = low if 2 * (rest % unit) <= unit or low >= limit else low + 1
    # the step by which each sum was reached first: the sum before it was reached by an earlier one
    first = np.full(limit + 1, -1, dtype=np.int16 if sum(c.bit_length() for c in counts.values()) < 1 << 15 else np.int32)
    first[0], steps = 0, []
    for size in sorted(counts):
        n, k = min(counts[size], limit // size), 1
        while n > 0 and (want < 0 or first[want] < 0):
            k = min(k, n)
            steps.append((size, k))
            at = np.flatnonzero((first[: -size * k] >= 0) & (first[size * k :] < 0))
            first[at + size * k] = len(steps)
            n -= k
            k *= 2
    sums = np.flatnonzero(first >= 0)
    k = int(np.searchsorted(sums, low, side="right"))
    total = min((int(s) for s in sums[max(0, k - 1) : k + 1]), key=lambda s: (abs(rest - s * unit), s))
    add: dict[int, int] = {}
    while total:
        size, k = steps[first[total] - 1]
        add[size] = add.get(size, 0) + k
        total -= size * k
    return add


def _closest_of_few(counts: dict[int, int], rest: int, unit: int, limit: int) -> dict[int, int]:
    """As ``_closest_sum``, over a table of the sums, for few items of whatever size."""
    reached: dict[int, dict[int, int]] = {0: {}}
    for size, c in counts.items():
        for total, used in list(reached.items()):
            for k in range(1, c + 1):
                if total + size * k > limit:
                    break
                reached.setdefault(total + size * k, used | {size: k})
    return reached[min(reached, key=lambda t: (abs(rest - t * unit), t))]

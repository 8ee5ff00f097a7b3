"""Optimal partitioning with pruning: the one sequential step, run once per series inside a grouped task.

``costs(starts, end)`` gives the cost of [start, end) for an array of starts; NaN means "too short to judge": such a
start is neither chosen nor pruned.
"""

from __future__ import annotations

import numpy as np


def partition(n: int, beta: float, costs, first: int = 1, slack=None, newest: int = 1, known: bool = False, least: int = 1) -> list[int]:
    """Change points that minimise the sum of costs plus ``beta`` each; ties go to the smallest start.

    ``first``: end of the first step. ``slack(starts, end)``: a start stays while its value without beta is at most the
    best plus slack; the sum is least if cutting a segment in two never costs more than slack. ``newest``: least length
    of the newest start offered. ``known``: the prefix of one row is priced by its cost, and both 0 and 1 are starts from
    the second step on (the rule of the moment families). ``least``: rows from which on a cost obeys that rule. A start
    is judged from that length on only, and one that has lost goes when what follows is that long too: until then a cut
    there may cost more than it will.
    """
    total, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    total[0] = -beta
    starts = np.array([0])
    if known and n >= 1:
        total[1] = costs(starts, 1)[0]
        starts, first = np.array([0, 1]), 2
    leaves = np.full(n + 1, n + 1)  # the first end for which a start is not offered
    for end in range(first, n + 1):
        usable = starts[starts <= end - newest] if newest > 1 else starts
        value = total[usable] + costs(usable, end)
        if np.isfinite(value).any():
            best = int(np.nanargmin(value))
            total[end], back[end] = value[best] + beta, usable[best]
            lost = value > total[end] + (slack(usable, end) if slack else 0.0)
            if least > 1:
                judged = usable[lost & (usable <= end - least)]
                leaves[judged] = np.minimum(leaves[judged], end + least)
                lost = leaves[usable] <= end + 1
            starts = np.concatenate([usable[~lost], starts[len(usable) :]])
        starts = np.append(starts, end) if newest == 1 else np.unique(np.append(starts, end))
    return trace(back, n)


#: Starts that are bounded together, ends that are priced together at most and at least, starts that are priced anew at
#: once, and prices of a block.
GROUP, MOST, FEWEST, HELD, PRICES = 256, 128, 16, 1_000_000, 16_384


def partition_blocks(n: int, beta: float, cost, known: bool = False) -> list[int]:
    """The change points of ``partition`` without pruning, in blocks of ends and without pricing each start at each end.

    Needs a cost of one column with ``pairs(start, end)`` (the costs, over arrays of both) and ``under(start, end)``: what
    [start, end) adds at least to a segment that it prolongs, with the part before at its own ``under``, wherever both
    have ``cost.least`` rows. Up to 256 starts share the least of their values at the end where they were priced last; what
    the rows since add at least bounds them from below. They are priced anew only if that bound falls to what the last
    best start would cost, and leave once it exceeds the value of a start between. A long run without changes, where
    pruning never takes a start out, so costs little more than one price a row.
    """
    total, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    total[0], t, least = -beta, 0, cost.least
    if known and n >= 1:
        total[1], t = cost.pairs(np.array([0]), np.array([1]))[0], 1
    low, seen, alive, made, size = np.full(n // GROUP + 1, -np.inf), np.zeros(n // GROUP + 1, np.int64), np.zeros(0, np.int64), 0, FEWEST

    def based(starts: np.ndarray, r: int) -> np.ndarray:
        value = total[starts] + cost.under(starts, r)
        value[cost.unbounded(starts, r)] = -np.inf
        return value

    while t < n:
        ends = np.arange(t + 1, min(t + size, n) + 1)
        r = t + 1 - least  # all later ends are at least ``least`` rows away
        old = max(r - least + 1, 0)  # starts before it have a bound
        offered = []
        if old:
            ref = back[t]
            gap = np.maximum.accumulate(total[ref] + cost.pairs(ref, ends) - cost.under(r, ends))
            ends = ends[: max(1, int(np.searchsorted(gap, gap[0] + beta / 2, "right")))]  # a jump would open every start
            limit = gap[len(ends) - 1]
            limit, gone = limit + 1e-6 + 1e-9 * abs(limit), total[r] + 1e-6 + 1e-9 * abs(total[r])
            if (full := old // GROUP) > made:
                alive, made = np.concatenate([alive, np.arange(made, full)]), full
            if len(alive):
                bound = low[alive] + cost.under(seen[alive], r)
                anew = (bound <= limit) | (r - seen[alive] < least)
                for some in np.array_split(alive[anew], anew.sum() * GROUP // HELD + 1):
                    starts = (some[:, None] * GROUP + np.arange(GROUP)).ravel()
                    value = based(starts, r)
                    low[some], seen[some] = value.reshape(-1, GROUP).min(1, initial=np.inf), r
                    offered.append(starts[value <= limit])
                bound[anew] = low[alive[anew]]
                alive = alive[bound <= gone]
            rest = np.arange(made * GROUP, old)
            offered.append(rest[based(rest, r) <= limit])
        starts = np.concatenate([*offered, np.arange(old, t + 1)])
        ends = ends[: max(1, PRICES // len(starts))]
        value = total[starts][:, None] + cost.pairs(starts[:, None], ends)
        best = value.argmin(0)
        value, chosen = value[best, np.arange(len(ends))], starts[best]
        if len(ends) > 1:  # does a start inside the block beat those before it?
            inner = np.where(ends[:-1, None] < ends[1:], (value[:-1] + beta)[:, None] + cost.pairs(ends[:-1, None], ends[1:]), np.inf)
            wins = inner.min(0) < value[1:]
            if wins.any():
                k = int(wins.argmax())
                j = int(inner[:, k].argmin())
                ends, value, chosen = ends[: k + 2], value[: k + 2], chosen[: k + 2]
                value[k + 1], chosen[k + 1] = inner[j, k], ends[j]
                size = max(FEWEST, min(size, 2 * len(ends)))
        if len(ends) == size:
            size = min(2 * size, MOST)
        total[ends], back[ends] = value + beta, np.where(np.isfinite(value), chosen, 0)
        t = int(ends[-1])
    return trace(back, n)


def trace(back: np.ndarray, n: int) -> list[int]:
    out, at = [], n
    while at > 0:
        at = int(back[at])
        if at > 0:
            out.append(at)
    return out[::-1]


def calibrate(solve, target: int, lo: float = 0.0, hi: float = 1e9, rounds: int = 20) -> tuple[float, list[int]]:
    """Bisect the penalty, on a logarithmic scale, until ``solve(beta)`` has ``target`` change points, or as near from above as it comes."""
    found = solve(lo)
    if len(found) <= target:
        return lo, found
    for _ in range(8):
        if len(solve(hi)) <= target:
            break
        hi *= 10
    best, lo = hi, max(lo, hi * 1e-12)
    for _ in range(2 * rounds):
        mid = (lo * hi) ** 0.5
        got = solve(mid)
        if len(got) == target:
            return mid, got
        lo, hi = (mid, hi) if len(got) > target else (lo, mid)
        best = hi
    return best, solve(best)

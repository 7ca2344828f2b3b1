"""Suffix arrays by linear grouping (U. Baier, Linear-time suffix sorting, 2016).

First, suffixes are grouped by first symbol. Groups are processed from the greatest to the least: every
suffix of the group finds its previous smaller suffix, the nearest one to the left in a smaller
group, by following pointers; a suffix that is found k times has the group's context k times behind
its own, so it moves into a new group right after the one that it was in. In the end suffixes are
grouped by their Lyndon prefixes. Second, the suffix array is read from left to right: the suffix
before the one at hand, and the chain of its previous smaller suffixes, take the next free places
of their groups. No names are assigned anew and nothing recurs. Groups are kept in lists by number, linked in
order; a suffix that is alone in its group, the usual case late on, never moves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int] | np.ndarray) -> np.ndarray:
    """The order of the suffixes; the last symbol must be smaller than all others."""
    symbols = np.asarray(symbols)
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(symbols[order]) != 0))
    sizes = np.diff(np.append(first, n))
    at = np.empty(n, np.int64)
    at[order] = np.repeat(np.arange(len(first)), sizes)
    home, live = at.tolist(), sizes.tolist()
    ordered, begins = order.tolist(), first.tolist()
    members: list[list[int] | None] = [ordered[a : a + k] if k > 1 else None for a, k in zip(begins, live, strict=True)]
    alone = [ordered[a] for a in begins]  # the only member, where there is one
    before, after = list(range(-1, len(live) - 1)), [*range(1, len(live)), -1]
    done, prev = bytearray(n), [-1] * n

    def moved(suffixes: list[int], old: int) -> None:
        """Into a new group right behind the one that they were in."""
        new, following = len(live), after[old]
        live.append(len(suffixes))
        live[old] -= len(suffixes)
        members.append(suffixes)
        alone.append(suffixes[0])
        before.append(old)
        after.append(following)
        after[old] = new
        if following >= 0:
            before[following] = new
        for j in suffixes:
            home[j] = new

    g = len(live) - 1
    while g >= 0:
        inside = members[g]
        if inside is None or live[g] == 1:
            i = alone[g] if inside is None else next(i for i in inside if home[i] == g)
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0 and live[home[j]] > 1:
                moved([j], home[j])
        else:
            if live[g] != len(inside):
                inside = [i for i in inside if home[i] == g]
            found: dict[int, int] = {}
            for i in inside:
                done[i] = 1
                j = i - 1
                while j >= 0 and done[j]:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    found[j] = found.get(j, 0) + 1
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, k in found.items():
                if live[home[j]] > 1:
                    by_count.setdefault(k, {}).setdefault(home[j], []).append(j)
            for k in sorted(by_count, reverse=True):
                for old, suffixes in by_count[k].items():
                    if len(suffixes) < live[old]:  # or else the whole rest of the group moves: it is the new group already
                        suffixes.sort()
                        moved(suffixes, old)
        g = before[g]

    top = 0  # the sentinel's group stays the first
    free = [0] * len(live)
    total = 0
    while top >= 0:
        free[top] = total
        total += live[top]
        top = after[top]
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    free[home[n - 1]] += 1
    placed[n - 1] = 1
    for i in out:  # filled further ahead while it is read
        j = i - 1
        while j >= 0 and not placed[j]:
            g = home[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return np.array(out, np.int64)

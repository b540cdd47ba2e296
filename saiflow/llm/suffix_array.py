"""Suffix arrays by linear grouping.

Phase 1 refines groups of suffixes, processed from the highest to the lowest.
``prev[i]`` is the nearest earlier suffix of a lower group (the previous
smaller one); all suffixes between have been processed, so pointers are
followed, not positions. Suffixes that ``prev`` points to are moved out of
their group into a new one just above it, those pointed to more often higher.
At the end a group holds the suffixes that begin with the same Lyndon word.

Phase 2 walks the sorted suffixes upwards; from each it follows ``prev`` from
the position before and gives every suffix met its group's next free place. No
names are assigned anew and nothing is sorted recursively.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[list[int]], list[int]]:
    """Phase 1. Returns (prev, group of each suffix, members of each group, groups in ascending order)."""
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable")
    symbols = np.asarray(text)[order]
    bounds = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), n] if n else [0]
    members = [order[a:b].tolist() for a, b in zip(bounds, bounds[1:])]  # ascending positions
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    down, up = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    if members:
        up[-1] = -1
    top = len(members) - 1
    prev, done = [-1] * n, bytearray(n)
    g = top
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and (done[j] or group[j] == g):
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        for i in own:
            done[i] = 1
        if pointed:
            if len(pointed) == 1:
                rounds = [list(pointed)]
            else:
                by_count: dict[int, list[int]] = {}
                for j, c in pointed.items():  # ascending, as prev grows with the position
                    by_count.setdefault(c, []).append(j)
                rounds = [by_count[c] for c in sorted(by_count, reverse=True)]
            for moved in rounds:
                fresh: dict[int, int] = {}
                for j in moved:
                    h = group[j]
                    k = fresh.get(h)
                    if k is None:  # a new group just above h
                        k = fresh[h] = len(members)
                        members.append([])
                        above = up[h]
                        down.append(h)
                        up.append(above)
                        up[h] = k
                        if above >= 0:
                            down[above] = k
                    group[j] = k
                    members[k].append(j)
        g = down[g]
    ascending, g = [], 0 if members else -1
    while g >= 0:
        ascending.append(g)
        g = up[g]
    return prev, group, members, ascending


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order (a shorter prefix first)."""
    n = len(text)
    prev, group, members, ascending = lyndon_groups(text)
    free, at = [0] * len(members), 0
    for g in ascending:
        free[g] = at
        at += len(members[g])
    out, placed = [-1] * n, bytearray(n)
    k, s = -1, n  # the empty suffix is the least
    while True:
        j = s - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
        k += 1
        if k == n:
            return out
        s = out[k]


def repeated_starts(text: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Positions whose ``length`` symbols are those of positions of at least 2 in total weight.

    Positions of weight 0 count for nothing and are never returned. The
    suffixes that share their first ``length`` symbols are neighbours in the
    suffix array.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    sa = np.array(suffix_array(text.tolist()), np.int64)
    wide = np.concatenate([text, np.full(length, -1, text.dtype)])  # past the end: equal to no symbol of a window
    same = np.ones(n - 1, bool)
    for d in range(length):
        same &= wide[sa[:-1] + d] == wide[sa[1:] + d]
    run = np.concatenate([[0], np.cumsum(~same)])
    total = np.bincount(run, weights=weights[sa])
    return sa[(weights[sa] > 0) & (total[run] >= 2)]

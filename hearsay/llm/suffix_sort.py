"""Suffix arrays by grouping: suffixes in groups of equal Lyndon prefixes, then emitted in order.

The first phase keeps groups of suffixes in order, at first by their first byte, and
processes them from the greatest down.  Every suffix of the group points to the nearest
place before it that is not processed yet, its previous smaller one.  Places pointed to
have their Lyndon prefix extended by that of the group, once per pointer, and move to
a new group right behind their own.  The second phase walks through the array from the
least suffix on and puts the suffix before each, and then those it points to, at the next free place
of their groups.  Both phases take linear time; nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a text of non-negative whole numbers."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # Groups form a linked list in ascending order; members that moved on stay listed in their
    # old group and are passed over.
    kinds, codes = np.unique(text, return_inverse=True)
    by_code = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[by_code], np.arange(len(kinds) + 1))
    members = [by_code[cuts[k]:cuts[k + 1]].tolist() for k in range(len(kinds))]
    group = codes.tolist()
    below = list(range(-1, len(kinds) - 1))
    above = list(range(1, len(kinds))) + [-1]
    pointer = [-2] * n  # -2: not processed; the end of the text counts as the least suffix, before all
    g = len(kinds) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if own:
            # Places of the group count as processed for each other: ascending order sees to it.
            for i in own:
                pointer[i] = -3
            met = {}
            for i in own:
                j = i - 1
                while j >= 0 and pointer[j] != -2:
                    j = pointer[j]
                pointer[i] = j
                if j >= 0:
                    met[j] = met.get(j, 0) + 1
            moved = {}
            for j, times in met.items():
                moved.setdefault((group[j], times), []).append(j)
            for home, times in sorted(moved, reverse=True):
                # Greater repetitions first, so that lesser ones come to stand before them.
                new, part = len(members), moved[home, times]
                part.sort()
                members.append(part)
                up = above[home]
                above.append(up)
                below.append(home)
                above[home] = new
                if up >= 0:
                    below[up] = new
                for j in part:
                    group[j] = new
        g = below[g]
    return np.array(_emit(n, members, group, below, above, pointer), dtype=np.int64)


def _emit(n, members, group, below, above, pointer):
    first = [0] * len(members)
    g = 0
    while below[g] >= 0:
        g = below[g]
    at = 0
    while g >= 0:
        first[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    placed = bytearray(n)
    j = n - 1  # the suffix before the end of the text
    at = -1
    while True:
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            order[first[g]] = j
            first[g] += 1
            j = pointer[j]
        at += 1
        if at == n:
            return order
        j = order[at] - 1

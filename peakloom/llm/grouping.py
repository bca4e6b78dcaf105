"""Suffix arrays by linear grouping construction (Baier 2016).

A suffix's Lyndon prefix reaches up to the next smaller suffix. Suffixes with equal Lyndon prefixes form a group, groups
are ordered by that prefix, and within a group suffixes are ordered by what follows the prefix: a smaller suffix. So
groups are made first, then their orders are read off in one pass over the growing array; nothing is renamed or sorted
recursively.
"""

from __future__ import annotations

from collections import defaultdict

#: A pointer that is still to be found.
UNSET = -2


def suffix_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the first slot of its group in the array, and the nearest smaller suffix to its left (-1: none).

    Symbols are whole numbers without wide gaps, as they are counted and not sorted. Groups begin as equal first symbols and are taken in descending order. When a group comes up its suffixes are
    final; each one's previous-smaller pointer leads to the suffix whose prefix ends where it begins. Those to which k
    of the group's suffixes point grow by k copies of the group's prefix, and go to a new group behind the rest of
    their old one, larger k behind smaller.
    """
    n = len(s)
    size: dict[int, int] = {}
    counts: dict[int, int] = defaultdict(int)
    for c in s:
        counts[c] += 1
    first, at = {}, 0
    for c in range(min(s, default=0), max(s, default=-1) + 1):
        if c not in counts:
            continue
        first[c], size[at] = at, counts[c]
        at += counts[c]
    group = [first[c] for c in s]
    slots, slot_of, fill = [0] * n, [0] * n, dict(first)
    for i, c in enumerate(s):
        k = fill[c]
        fill[c] = k + 1
        slots[k], slot_of[i] = i, k
    prev = [UNSET] * n
    end = n
    while end:
        g = group[slots[end - 1]]
        if end - g == 1:  # most groups hold one suffix
            i = slots[g]
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                o = group[p]
                k = size[o]
                if k > 1:
                    last = o + k - 1
                    q, a = slots[last], slot_of[p]
                    slots[a], slots[last], slot_of[q], slot_of[p] = q, p, a, last
                    size[o], size[last], group[p] = k - 1, 1, last
            end = g
            continue
        pointed: dict[int, int] = {}
        for member in slots[g:end]:
            # A pointer may lead over a member whose own pointer is still to be found: that one goes first.
            waiting = [(member, member - 1)] if prev[member] == UNSET else []
            while waiting:
                i, p = waiting.pop()
                while p >= 0 and group[p] >= g:
                    if prev[p] == UNSET:
                        waiting += [(i, p), (p, p - 1)]
                        break
                    p = prev[p]
                else:
                    prev[i] = p
                    if p >= 0:
                        pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = defaultdict(list)
        for p, k in pointed.items():
            by_count[k].append(p)
        # The counts add up to the group's size, so there are no more than its root's worth of different ones to sort.
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = defaultdict(list)
            for p in by_count[k]:
                moved[group[p]].append(p)
            for o, members in moved.items():
                for p in members:
                    size[o] -= 1
                    last = o + size[o]
                    q, a = slots[last], slot_of[p]
                    slots[a], slots[last], slot_of[q], slot_of[p] = q, p, a, last
                new = o + size[o]
                size[new] = len(members)
                for p in members:
                    group[p] = new
        end = g
    return group, prev


def suffix_array(s: list[int]) -> list[int]:
    """Start of every suffix of ``s`` (comparable symbols), in ascending order; a suffix that ends first is smaller."""
    n = len(s)
    group, prev = suffix_groups(s)
    array, placed, fill = [0] * n, bytearray(n), {}

    def emit(after: int) -> None:
        """Those whose Lyndon prefix ends where the suffix just placed begins: they follow it in their groups' orders."""
        i = after - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            k = fill.get(g, g)
            fill[g] = k + 1
            array[k] = i
            placed[i] = 1
            i = prev[i]

    emit(n)
    for k in range(n):
        emit(array[k])
    return array

"""Suffix array by linear grouping construction.

Suffixes are grouped by the longest Lyndon word they begin with. Phase one visits the groups in
descending order: each member points to the nearest suffix before it in a lower group (its
previous smaller one), whose Lyndon prefix is thereby known to go on with the group's; suffixes
pointed to more often move to higher new groups behind their old one. Phase two fills the array
from the left: each suffix found brings the one before it, and along the pointers all that are
not placed yet, to the front of their groups. There is no recursion and no renaming.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes of symbols (integers over 0) in lexicographic order."""
    text = [*symbols, 0]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(order):
        if i and text[s] != text[order[i - 1]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    smaller = [-1] * n

    end = n
    while end > 0:
        start = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for s in sorted(order[start:end]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        levels: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            levels.setdefault(times, {}).setdefault(group[p], []).append(p)
        for times in sorted(levels, reverse=True):
            for members in levels[times].values():
                old = group[members[0]]  # all members still share it: those pointed to more often have left
                if len(members) == size[old]:
                    continue
                k = old + size[old]
                size[old] -= len(members)
                new = old + size[old]
                size[new] = len(members)
                for p in members:
                    k -= 1
                    q, i = order[k], place[p]
                    order[i], place[q] = q, i
                    order[k], place[p] = p, k
                    group[p] = new
        end = start

    out, front, done = [-1] * n, list(range(n)), [False] * n
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            done[s] = True
            s = smaller[s]
    return out[1:]

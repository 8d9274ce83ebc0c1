"""Linear-time suffix sorting by Lyndon-prefix groups."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of a sequence of integers in lexicographic order; where one suffix
    is a prefix of another, the shorter comes first.

    Grouping: suffixes start out grouped by first symbol. Groups are processed from the highest to the
    lowest. Every member of a group finds its nearest predecessor in a lower group by previous-smaller
    pointers; predecessors that are pointed at by more members sort higher, so they move, most pointers
    first, to a new group right above their old one. In the end a group holds the suffixes with the
    same Lyndon prefix.

    Emission: in ascending order, each placed suffix places those whose Lyndon prefix ends where it
    begins, at the next free place of their group. They are its left neighbour and that one's chain of
    previous-smaller pointers. Nothing is renamed and nothing recurses; time and space are linear.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    _, rank = np.unique(np.asarray(symbols), return_inverse=True)
    start_of = np.zeros(int(rank.max()) + 2, dtype=np.int64)
    np.cumsum(np.bincount(rank), out=start_of[1:])
    group = start_of[rank].tolist()  # a group's name is its first place
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    order, place = order.tolist(), place.tolist()
    size = [0] * n
    for first, count in zip(start_of[:-1].tolist(), np.diff(start_of).tolist()):
        size[first] = count
    before = [-1] * n
    end = n
    while end > 0:
        first = group[order[end - 1]]
        members = order[first:end]
        end = first
        if len(members) == 1:
            i = members[0]
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:  # one pointer: its target moves to the top of its group
                g = group[p]
                size[g] -= 1
                if size[g]:
                    top = g + size[g]
                    other, at = order[top], place[p]
                    order[at], place[other] = other, at
                    order[top], place[p], group[p] = p, top, top
                    size[top] = 1
                else:
                    size[g] = 1
            continue
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, count in pointed.items():
            by_count.setdefault(count, []).append(p)
        for count in sorted(by_count, reverse=True):
            left: dict[int, int] = {}
            for p in by_count[count]:
                g = group[p]
                size[g] -= 1
                left[g] = left.get(g, 0) + 1
                top = g + size[g]
                other, at = order[top], place[p]
                order[at], place[other] = other, at
                order[top], place[p] = p, top
            for g, moved in left.items():
                new = g + size[g]
                size[new] = moved
                for k in range(new, new + moved):
                    group[order[k]] = new
    out = [-1] * n
    free = list(range(n))  # per group's first place: its next free place
    placed = [False] * n
    for k in range(-1, n):
        i = (n if k < 0 else out[k]) - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = before[i]
    return np.array(out)

"""Suffix arrays by grouping (linear, without recursion or renaming).

First phase: suffixes are grouped by their Lyndon prefix.  Groups are taken in
descending order; every suffix of a group points to the nearest suffix before it
that lies in a smaller group, and those targets move to new groups just above
the rest of theirs, the higher the more of the group's suffixes point to them.
Second phase: from the least suffix on, each one placed releases the suffixes
whose Lyndon prefix ends where it starts, which take the next free place of
their group.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in lexicographic order (a suffix that is
    another's prefix comes first).  Symbols are integers of any size."""
    n = len(s)
    if n < 2:
        return list(range(n))
    # an end marker below every symbol
    count: dict[int, int] = {}
    for c in s:
        count[c] = count.get(c, 0) + 1
    begin, at = {}, 1
    for c in sorted(count):
        begin[c] = at
        at += count[c]
    sa = [n] * (n + 1)  # suffixes by group
    place = [0] * (n + 1)  # place of a suffix in sa
    group = [0] * (n + 1)  # first place of a suffix's group
    size = [0] * (n + 2)  # members of the group that starts at a place
    size[0] = 1
    free = dict(begin)
    for i, c in enumerate(s):
        g = begin[c]
        p = free[c]
        free[c] = p + 1
        sa[p], place[i], group[i] = i, p, g
        size[g] += 1
    before = [-1] * (n + 1)

    end = n  # last place of the group at hand
    while end > 0:
        start = group[sa[end]]
        members = sa[start : end + 1]
        members.sort()
        # nearest suffix before each that lies in a smaller group
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        # targets move to new groups above the rest of their own, by count
        if pointed:
            levels: dict[int, list[int]] = {}
            for j, k in pointed.items():
                if k in levels:
                    levels[k].append(j)
                else:
                    levels[k] = [j]
            for k in sorted(levels, reverse=True):
                moved: dict[int, int] = {}
                for j in levels[k]:
                    g = group[j]
                    last = g + size[g] - 1  # the group shrinks from its end
                    p, other = place[j], sa[last]
                    sa[p], place[other] = other, p
                    sa[last], place[j] = j, last
                    size[g] -= 1
                    moved[g] = moved.get(g, 0) + 1
                    group[j] = -1 - g
                above = {g: g + size[g] for g in moved}
                for j in levels[k]:
                    group[j] = above[-1 - group[j]]
                for g, m in moved.items():
                    size[above[g]] = m
        end = start - 1

    # second phase: sa is filled in order
    free_at = list(range(n + 2))
    out = [-1] * (n + 1)
    out[0] = n
    for r in range(n + 1):
        j = out[r] - 1
        end_at = out[r]
        while j >= 0:
            if place[j] < 0:  # placed already
                break
            g = group[j]
            p = free_at[g]
            out[p] = j
            free_at[g] = p + 1
            place[j] = -1
            j = before[j]
    return out[1:]

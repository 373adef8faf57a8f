"""Suffix array by linear grouping: Lyndon groups refined in descending order, then ordered by induction, without recursion."""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """(group, previous) of each suffix: the first rank of its group of equal longest Lyndon prefixes, and its previous smaller suffix up to ties.

    Suffixes start in groups by their first symbol. Groups are final from the greatest down: when group G with Lyndon prefix
    L comes up, each of its suffixes finds its previous suffix of a smaller group by the pointers of the greater ones. A suffix p
    that is so found k times in a row goes on with k copies of L, so it leaves its group for a new one just above, those with
    more copies higher.
    """
    n = len(text)
    ranks = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for r, i in enumerate(ranks):
        if r and text[i] != text[ranks[r - 1]]:
            start = r
        place[i], group[i] = r, start
        size[start] += 1
    previous = [-1] * n
    end = n
    while end:
        start = group[ranks[end - 1]]
        times: dict[int, int] = {}
        for i in sorted(ranks[start:end]) if end - start > 1 else (ranks[start],):
            p = i - 1
            while p >= 0 and group[p] > start:
                p = previous[p]
            if p >= 0 and group[p] == start:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        end = start
        found = list(times)
        copies = 1
        while found:
            moved: dict[int, int] = {}
            for p in found:
                g = group[p]
                moved[g] = m = moved.get(g, 0) + 1
                to, at = g + size[g] - m, place[p]
                q = ranks[to]
                ranks[at], ranks[to] = q, p
                place[q], place[p] = at, to
            split = {}
            for g, m in moved.items():
                if m < size[g]:
                    size[g] -= m
                    split[g] = above = g + size[g]
                    size[above] = m
            if split:
                for p in found:
                    g = group[p]
                    if g in split:
                        group[p] = split[g]
            copies += 1
            found = [p for p in found if times[p] >= copies]
    return group, previous


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes of text in ascending order; a suffix that is a prefix of another comes first.

    Within a group the order is that of the suffixes that follow the common Lyndon prefix, which are smaller and so known
    already: going through the result, each suffix s puts the suffixes that end at s into the next free places of their groups.
    """
    n = len(text)
    group, previous = lyndon_groups(text)
    free = list(range(n))  # the next free place of the group that begins there
    result, done = [0] * n, [False] * n
    for r in range(-1, n):
        i = (n if r < 0 else result[r]) - 1
        while i >= 0 and not done[i]:
            g = group[i]
            result[free[g]] = i
            free[g] += 1
            done[i] = True
            i = previous[i]
    return result

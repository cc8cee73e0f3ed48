"""Suffix arrays by linear grouping: Lyndon-prefix groups, then one emission pass.

Phase 1 keeps suffixes in groups ordered by a shared prefix, at first their first symbol,
and processes groups from the greatest down. When a group is processed, its shared
prefix is the Lyndon prefix of its members. For each member the nearest suffix to the left that is not yet
processed is smaller: its *previous smaller* pointer. The prefix of such a smaller suffix
grows by the group's prefix, once for every member that points to it, so it moves to a new group directly above its
old one; more repetitions are greater.

Phase 2 reads the suffix array from the left while it fills it: the suffix before each
entry, and those its pointers lead to, take the next free place of their groups. No
group is sorted again and nothing is renamed or solved recursively.
"""

from __future__ import annotations

from collections.abc import Sequence

_OPEN = -2


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Groups of suffixes in ascending order, and the previous smaller suffix of each (-1: none)."""
    symbols = sorted(set(text))
    number = {symbol: i for i, symbol in enumerate(symbols)}
    group = [number[symbol] for symbol in text]
    members: list[set[int]] = [set() for _ in symbols]
    for i, g in enumerate(group):
        members[g].add(i)
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    previous = [_OPEN] * len(text)
    processed: list[list[int]] = []
    current = len(symbols) - 1
    while current >= 0:
        own = sorted(members[current])
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and previous[j] != _OPEN:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if own:
            processed.append(own)
        growing: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            growing.setdefault((group[p], times), []).append(p)
        for old, times in sorted(growing, reverse=True):  # of one group, more repetitions first
            some = growing[old, times]
            if len(some) == len(members[old]):
                continue  # what is left of the group grows alike
            new = len(members)
            members.append(set(some))
            members[old].difference_update(some)
            for p in some:
                group[p] = new
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
        current = below[current]
    processed.reverse()
    return processed, previous


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a suffix is greater than its prefixes."""
    n = len(text)
    groups, previous = lyndon_groups(text)
    free = [0] * n  # next free place of a suffix's group, kept at the group's first member
    leader = [0] * n
    place = 0
    for own in groups:
        for i in own:
            leader[i] = own[0]
        free[own[0]] = place
        place += len(own)
    array = [-1] * n
    placed = bytearray(n)
    for at in range(-1, n):
        j = (n if at < 0 else array[at]) - 1  # the empty suffix comes first
        while j >= 0 and not placed[j]:
            placed[j] = 1
            first = leader[j]
            array[free[first]] = j
            free[first] += 1
            j = previous[j]
    return array

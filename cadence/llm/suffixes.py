"""Suffix arrays by linear grouping, and the repeated windows of a set of strings."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """The suffix array of ``text`` (integers above 0) with a smallest end mark appended; the end mark comes first.

    Suffixes are first grouped by their Lyndon prefixes. Groups are intervals of one array, taken in descending order:
    the previous-smaller pointers of a group's suffixes show which earlier suffixes get a longer prefix, and these
    move to a new group right after their old one, those with more such pointers last. Then one ascending pass emits
    the order: an emitted suffix places the one before it, and the chain of previous-smaller suffixes of that one,
    each at the next free place of its group. Both passes look at every suffix a constant number of times.
    """
    n = len(text) + 1
    symbols = np.zeros(n, np.int64)
    symbols[:-1] = text
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order][1:] != symbols[order][:-1]
    starts = np.flatnonzero(new)
    at = order.tolist()  # suffixes by group
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    where = where.tolist()  # place of each suffix in ``at``
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    group = group.tolist()  # first place of the group of each suffix
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    size = size.tolist()
    smaller = [-1] * n
    end = n
    while end > 1:
        first = group[at[end - 1]]
        members = at[first:end]
        if len(members) > 1:
            members.sort()
        end = first
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, c in counts.items():
            levels.setdefault(c, []).append(j)
        for c in sorted(levels, reverse=True) if len(levels) > 1 else levels:
            touched: dict[int, list[int]] = {}
            for j in levels[c]:
                g = group[j]
                size[g] = left = size[g] - 1
                here, last = where[j], g + left
                if here != last:
                    other = at[last]
                    at[here], where[other] = other, here
                    at[last], where[j] = j, last
                if g in touched:
                    touched[g].append(j)
                else:
                    touched[g] = [j]
            for g, moved in touched.items():
                start = g + size[g]
                size[start] = len(moved)
                if start != g:
                    for j in moved:
                        group[j] = start
    out = [0] * n
    out[0] = n - 1
    free = list(range(n))  # next free place of the group that starts here
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def repeated_starts(strings: list[bytes], length: int, copies: list[int] | None = None) -> list[np.ndarray]:
    """For each string the starts of its windows of ``length`` that also start elsewhere in the strings.

    Equal neighbours in the suffix array of all strings show it: of the suffixes that share a window with one, the
    next to it in order does. ``copies`` says how often each string occurs; a suffix of one that occurs twice is its
    own neighbour.
    """
    ends = np.cumsum([len(s) + 1 for s in strings])
    joined = b"\0".join(strings) + b"\0"
    symbols = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    symbols[ends - 1] = 1
    order = np.array(suffix_array(symbols), np.int64)[1:]
    rest = np.empty(len(symbols), np.int64)
    begin = 0
    for end in ends.tolist():
        rest[begin:end] = end - 1 - np.arange(begin, end)
        begin = end
    order = order[rest[order] >= length]
    flags = np.zeros(len(symbols), bool)
    if copies is not None:
        own = np.repeat(np.array(copies) > 1, np.diff(ends, prepend=0))
        flags[order] = own[order]
    if not len(order):
        return [np.empty(0, np.int64) for _ in strings]
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), length)
    for lo in range(0, len(order) - 1, 20_000):
        part = order[lo : lo + 20_001]
        a, b = part[:-1], part[1:]
        same = (windows[a] == windows[b]).all(1)
        flags[a[same]] = True
        flags[b[same]] = True
    return [np.flatnonzero(flags[end - len(s) - 1 : end]) for s, end in zip(strings, ends.tolist(), strict=True)]

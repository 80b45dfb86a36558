"""Suffix sorting by Lyndon-prefix groups, for many independent strings at once.

Phase 1 takes the groups of a string in descending order.  Every suffix of the
group finds, over previous-smaller pointers, the nearest position before it in a
lower group; the positions so found move from their groups into new groups just
above, those found by more suffixes further up.  In the end the suffixes of a
group share their longest Lyndon prefix.  Phase 2 goes up the groups and emits
their order: a suffix that has its place gives the next free places of their
groups to its left neighbour and to that one's chain of previous-smaller
pointers.  No string is renamed or sorted recursively.

All strings take their steps together, so that a step is a few array operations
however many strings there are.  Positions are four bytes wide wherever they fit.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after the other."""
    total = int(size.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return shift + np.arange(total)


def suffix_arrays(text: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The suffix arrays of the strings text[offs[k] : offs[k + 1]], one after the other, as positions in text.

    Each string has a last symbol that is smaller than all its others; symbols are small non-negative integers.
    """
    n = len(text)
    base, sizes = offs[:-1].astype(np.int64), np.diff(offs).astype(np.int64)
    none = n  # "no position": below every group
    group, size, prev = _lyndon_groups(text, base, sizes, none)
    return _emit(group, size, prev, base, sizes, none, n)


def _width(most: int) -> type:
    return np.int32 if most < 1 << 31 else np.int64


def _lyndon_groups(text: np.ndarray, base: np.ndarray, sizes: np.ndarray, none: int):
    n = len(text)
    kind = _width(n)
    first = np.zeros(n + 1, bool)
    first[base[sizes > 0]] = True
    symbols = int(text.max(initial=0)) + 1
    key = np.repeat(np.arange(len(base), dtype=_width(len(base) * symbols)) * symbols, sizes)  # string, then symbol
    key += text
    order = np.argsort(key, kind="stable").astype(kind)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).astype(kind) if n else np.zeros(0, kind)
    del key
    length = np.diff(np.append(new, n))
    size = np.zeros(n + 1, kind)
    size[new] = length
    group = np.full(n + 1, -1, kind)  # a position's group: the place where it starts
    group[order] = np.repeat(new, length)
    rank = np.empty(n + 1, kind)
    rank[order] = np.arange(n, dtype=kind)
    prev = np.full(n + 1, none, kind)
    moved = np.zeros(n + 1, bool)
    cursor, low = (base + sizes)[sizes > 0], base[sizes > 0]
    while len(cursor):
        at = group[order[cursor - 1]]
        count = cursor - at
        s = order[_ranges(at, count)]
        mine = np.repeat(at, count)
        # The nearest position before s whose group isn't higher ...
        p = np.where(first[s], none, s - 1)
        todo = np.flatnonzero(group[p] > mine)
        while len(todo):
            p[todo] = prev[p[todo]]
            todo = todo[group[p[todo]] > mine[todo]]
        prev[s] = p
        # ... and if it is of this group, where that one's pointer leads (by pointer doubling).
        todo = np.flatnonzero(group[p] == mine)
        while len(todo):
            p[todo] = prev[p[todo]]
            prev[s[todo]] = p[todo]
            todo = todo[group[p[todo]] == mine[todo]]
        p = p[p != none]
        if len(p):
            p = np.sort(p)
            cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            times = np.diff(np.append(cut, len(p)))
            p = p[cut]
            g = group[p]
            by = np.lexsort((times, g))
            p, g, times = p[by], g[by], times[by]
            new_g = np.concatenate(([True], g[1:] != g[:-1]))
            lead = np.flatnonzero(new_g)
            old, many = g[lead], np.diff(np.append(lead, len(g)))
            tail_start = old + size[old] - many
            tail = _ranges(tail_start, many)
            # Those that stay but stand in the tail change places with those that go and stand before it.
            moved[p] = True
            stay = order[tail]
            stay = stay[~moved[stay]]
            where = rank[p]
            free = where[where < np.repeat(tail_start, many)]
            order[free] = stay
            rank[stay] = free
            order[tail] = p
            rank[p] = tail
            moved[p] = False
            run = np.flatnonzero(new_g | np.concatenate(([True], times[1:] != times[:-1])))
            of = np.diff(np.append(run, len(p)))
            size[old] -= many
            size[tail[run]] = of
            group[p] = np.repeat(tail[run], of)
        cursor = at
        left = cursor > low
        cursor, low = cursor[left], low[left]
    return group, size, prev


def _emit(group: np.ndarray, size: np.ndarray, prev: np.ndarray, base: np.ndarray, sizes: np.ndarray, none: int, n: int) -> np.ndarray:
    out = np.full(n, -1, _width(n))
    filled = np.zeros(n + 1, _width(n))
    placed = np.zeros(n + 1, bool)
    placed[none] = True
    first = np.zeros(n + 1, bool)
    some = sizes > 0
    first[base[some]] = True
    last = (base + sizes - 1)[some]  # the smallest suffix of each string: its end mark
    cursor, high = base[some].copy(), (base + sizes)[some]
    out[cursor] = last
    filled[cursor] = 1
    placed[last] = True
    while len(cursor):
        g = group[out[cursor]]
        end = g + filled[g]
        i = _ranges(cursor, end - cursor)
        s = out[i]
        s = np.where(first[s], none, s - 1)
        who, level, got_s, got_i, got_l = i, 0, [], [], []
        while True:
            go = ~placed[s]
            s, who = s[go], who[go]
            if not len(s):
                break
            # Of several that come to one position the first one counts; the others would go the same way on.
            by = np.lexsort((who, s))
            s, who = s[by], who[by]
            keep = np.concatenate(([True], s[1:] != s[:-1]))
            s, who = s[keep], who[keep]
            got_s.append(s)
            got_i.append(who)
            got_l.append(np.full(len(s), level))
            s = prev[s]
            level += 1
        if got_s:
            s, who, level = np.concatenate(got_s), np.concatenate(got_i), np.concatenate(got_l)
            if len(got_s) > 1:
                by = np.lexsort((level, who, s))
                s, who, level = s[by], who[by], level[by]
                keep = np.concatenate(([True], s[1:] != s[:-1]))
                s, who, level = s[keep], who[keep], level[keep]
            to = group[s]
            by = np.lexsort((level, who, to))
            s, to = s[by], to[by]
            lead = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            many = np.diff(np.append(lead, len(to)))
            out[_ranges(to[lead] + filled[to[lead]], many)] = s
            filled[to[lead]] += many
            placed[s] = True
        cursor = end
        left = cursor < high
        cursor, high = cursor[left], high[left]
    return out

"""Suffix arrays by grouping, in linear time, without recursive renaming.

Phase 1 refines groups of suffixes until each holds the suffixes with the same longest Lyndon prefix. Groups are handled from
the highest down: every suffix of a group finds its previous suffix in a lower group (pointers that were found earlier
are jumped along), and these are moved just above the rest of their own group, ordered by how often they were found.
Phase 2 runs over the array from its smallest entry and emits the order inside each group.
"""
from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in ascending order; a suffix that is a prefix of another comes first."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    symbols = np.append(np.asarray(symbols, dtype=np.int64) - int(np.min(symbols)) + 1, 0)  # a unique least end
    n += 1
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    group_of = np.empty(n, dtype=np.int64)
    group_of[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    sa, place, group = order.tolist(), place.tolist(), group_of.tolist()
    size = [0] * n
    for h, s in zip(heads.tolist(), np.diff(np.append(heads, n)).tolist()):
        size[h] = s
    prev = [-1] * n
    _lyndon_groups(sa, place, group, size, prev, n)
    return np.array(_emit(sa, group, prev, n)[1:], dtype=np.int64)


def _lyndon_groups(sa, place, group, size, prev, n):
    end = n - 1
    while end >= 0:
        head = group[sa[end]]
        members = sorted(sa[head:end + 1])
        end = head - 1
        found: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        if not found:
            continue
        if len(found) > 1:
            by_count: dict[int, list[int]] = {}
            for j, c in found.items():
                by_count.setdefault(c, []).append(j)
            rounds = [by_count[c] for c in sorted(by_count, reverse=True)]
        else:
            rounds = [list(found)]
        for chosen in rounds:
            moved: dict[int, int] = {}
            for j in chosen:  # to the end of its group
                g = group[j]
                m = moved.get(g, 0)
                at, last = place[j], g + size[g] - 1 - m
                other = sa[last]
                sa[last], sa[at] = j, other
                place[j], place[other] = last, at
                moved[g] = m + 1
            for g, m in moved.items():
                left = size[g] - m
                if left:
                    size[g] = left
                    new = g + left
                    size[new] = m
                    for p in range(new, new + m):
                        group[sa[p]] = new


def _emit(sa, group, prev, n):
    out = [-1] * n
    start = list(range(n))  # next free place of the group that starts here
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            done[j] = True
            j = prev[j]
    return out


def common_prefix(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order (first: 0)."""
    n = len(symbols)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    s, r, o = np.asarray(symbols).tolist(), rank.tolist(), np.asarray(order).tolist()
    out, h = [0] * n, 0
    for i in range(n):
        if r[i]:
            j = o[r[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[r[i]] = h
            if h:
                h -= 1
        else:
            h = 0
    return np.array(out, dtype=np.int64)

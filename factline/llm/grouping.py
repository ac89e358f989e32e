"""Suffix arrays by linear grouping, for many short strings in step.

Suffixes are first grouped by their first symbol.  Groups are then processed from the highest to the lowest: the group at
hand is final, its members leave a list of open suffixes, and the nearest open suffix before a run of members (the
previous smaller one) takes the run into its own Lyndon prefix, which moves it above the rest of its group, the higher
the longer the run.  When all are processed, suffixes are grouped by their longest Lyndon prefix.  A second sweep, in
ascending order, emits each group's members in order: the suffix just before the one that is emitted, and from there along
the previous-smaller pointers, each goes to the front of its group until one is met that is already out.  Nothing is renamed
and solved again.

Both sweeps do the same small step in every string at once, as array operations, so that the cost of Python is shared by
thousands of strings.
"""

from __future__ import annotations

import numpy as np


def suffix_orders(symbols: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings that lie one after another in ``symbols``.

    String b is ``symbols[base[b] : base[b + 1]]``; its last symbol must be smaller than all its others.  The result has, in the same
    place, the suffixes' starts in ascending order.
    """
    prev, start = _group(symbols, base)
    return _emit(base, prev, start)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _group(symbols: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the previous-smaller pointer (-1: none) and the place where its final group starts."""
    n = len(symbols)
    string = np.repeat(np.arange(len(base) - 1), np.diff(base))
    key = string * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable")
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    size = np.diff(np.append(new, n))
    start = np.empty(n, np.int64)
    start[order] = np.repeat(new, size)
    end = np.zeros(n, np.int64)
    end[new] = new + size
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    before[base[:-1]] = -1
    after[base[1:] - 1] = -1
    prev = np.full(n, -1, np.int64)
    moved = np.zeros(n, bool)
    low, cursor = base[:-1].copy(), base[1:].copy()
    while len(cursor):
        first = start[order[cursor - 1]]
        members = np.sort(order[spread(first, cursor - first)])
        # runs of members with no other open suffix between them
        heads = np.ones(len(members), bool)
        heads[1:] = before[members[1:]] != members[:-1]
        at = np.flatnonzero(heads)
        length = np.diff(np.append(at, len(members)))
        parent, follower = before[members[at]], after[members[at + length - 1]]
        prev[members] = np.repeat(parent, length)
        has, goes = parent >= 0, follower >= 0
        after[parent[has]] = follower[has]
        before[follower[goes]] = parent[goes]
        cursor = first
        open_ = cursor > low
        cursor, low = cursor[open_], low[open_]
        parent, length = parent[has], length[has]
        if not len(parent):
            continue
        group = start[parent]
        by = np.lexsort((length, group))
        parent, length, group = parent[by], length[by], group[by]
        opens = np.ones(len(group), bool)
        opens[1:] = group[1:] != group[:-1]
        at = np.flatnonzero(opens)
        count = np.diff(np.append(at, len(group)))
        rest = end[group[at]] - count  # where what stays in the old group ends
        target = spread(rest, count)
        here = where[parent]
        moved[parent] = True
        there = order[target]
        stays = there[~moved[there]]
        freed = here[here < np.repeat(rest, count)]
        order[freed] = stays
        where[stays] = freed
        order[target] = parent
        where[parent] = target
        moved[parent] = False
        end[group[at]] = rest
        opens[1:] |= length[1:] != length[:-1]
        at = np.flatnonzero(opens)
        count = np.diff(np.append(at, len(group)))
        start[parent] = np.repeat(target[at], count)
        end[target[at]] = target[at] + count
    return prev, start


def _emit(base: np.ndarray, prev: np.ndarray, start: np.ndarray) -> np.ndarray:
    n = len(prev)
    out = np.full(n, -1, np.int64)
    front = np.arange(n)
    done = np.zeros(n, bool)
    first, stop = base[:-1], base[1:]
    at = first.copy()
    out[at] = stop - 1
    done[stop - 1] = True
    chain = np.where(stop - 1 > first, stop - 2, -1)
    while len(at):
        new = (chain >= 0) & ~done[chain]
        put = chain[new]
        group = start[put]
        place = front[group]
        out[place] = put
        front[group] = place + 1
        done[put] = True
        chain[new] = prev[put]
        old = ~new
        at[old] += 1
        live = at < stop
        if not live.all():
            at, stop, first, chain, old = at[live], stop[live], first[live], chain[live], old[live]
        head = out[at[old]]
        chain[old] = np.where(head > first[old], head - 1, -1)
    return out

"""What hangs together while connections come and go, swept inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chronoweave.operators.meetings import _spread

#: Members listed together.
LISTED = 1_000_000


def labels(many: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes ``0..many - 1``, the least one that edges ``a, b`` lead to."""
    label = np.arange(many)
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(up := label[label], label):
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def coded(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The users of ``user_a, user_b`` in order, and the place of each row's two among them."""
    both = pa.concat_arrays([table[c].combine_chunks() for c in ("user_a", "user_b")]).dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    code = place[both.indices.to_numpy()]
    return both.dictionary.take(order), code[:table.num_rows], code[table.num_rows:]


def stars(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Connections that last as long as each other, as one from each user to the least that they lead to."""
    users, a, b = coded(table)
    least = labels(len(users), a, b)
    other = np.flatnonzero(least != np.arange(len(users)))
    if len(other):
        same = [pa.repeat(table[c][0], len(other)) for c in names[2:]]
        yield pa.RecordBatch.from_arrays([users.take(pa.array(least[other])), users.take(pa.array(other)), *same], names=names)


def groups(table: pa.Table, start: int, stop: int, min_members: int, min_ms: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Longest stretches within ``start`` to ``stop`` in which a group has the same members: ``members, start_ms, end_ms, open``.

    ``open``: the group has the same members at the slot's beginning or end, so it may go on in the next one. Other groups are
    whole, and left out if they are shorter than ``min_ms``.
    """
    users, a, b = coded(table)
    low, high = (table[c].to_numpy() for c in ("_from", "_to"))
    at = np.unique(np.concatenate([low, high, [start, stop]]))
    begin, end, group, size, parent, child = _sweep(len(users), a, b, np.searchsorted(at, low), np.searchsorted(at, high), len(at) - 1, max(min_members, 2))
    begin, end = at[begin], at[end]
    edge = (begin == start) | (end == stop)
    keep = edge | (end - begin >= min_ms)
    begin, end, group, size, edge = (c[keep] for c in (begin, end, group, size, edge))
    total = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(group):
        last = max(first + 1, int(np.searchsorted(total, total[first] + LISTED, side="right")) - 1)
        members = users.take(pa.array(_members(group[first:last], len(users), parent, child)))
        lists = pa.ListArray.from_arrays(pa.array((total[first:last + 1] - total[first]).astype(np.int32)), members)
        yield pa.RecordBatch.from_arrays([lists, *[pa.array(c[first:last]) for c in (begin, end, edge)]], names=names)
        first = last


def _sweep(users: int, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, least: int) -> tuple[np.ndarray, ...]:
    """Groups of ``least`` users or more, with the steps they last: ``begin, end, group, size``, and of which others each consists.

    An edge ``a, b`` lasts from step ``low`` until ``high``. Time is halved again and again, all parts of one length at once. What
    is connected throughout a part becomes one node there, and edges within it are dropped; a node without further edges is a
    group for the whole part, the others go on to its halves. An edge lasts throughout two parts of one length at most whose
    double it does not fill, and goes on in two, so no step lists the edges of its time. Groups of neighbouring parts are one when two
    sums of 64 random bits a member agree.
    """
    wide = 1 << (steps - 1).bit_length()
    bits = np.random.default_rng(0).integers(0, 2 ** 64, (2, users), dtype=np.uint64)
    # a node: the group it stands for, the part of time it is in, the group's size and sums
    node = [np.arange(users), np.zeros(users, dtype=np.int64), np.ones(users, dtype=np.int64), bits[0], bits[1]]
    known, parent, child, found = users, [], [], []

    def report(which: np.ndarray, group: list[np.ndarray], part: np.ndarray) -> None:
        which = which[group[2][which] >= least]
        part = part[which]
        found.append([part * wide, np.minimum(part * wide + wide, steps), *[group[i][which] for i in (0, 2, 3, 4)]])

    while True:
        begins = node[1][a] * wide
        lasts = (low <= begins) & (high >= np.minimum(begins + wide, steps))
        root, own, many = np.unique(labels(len(node[0]), a[lasts], b[lasts]), return_inverse=True, return_counts=True)
        joined = [c[root] for c in node]
        more = many > 1
        joined[0][more] = known + np.arange(more.sum())
        known += int(more.sum())
        inner = more[own]
        parent.append(joined[0][own[inner]])
        child.append(node[0][inner])
        for i in (2, 3, 4):
            joined[i] = np.zeros_like(joined[i])
            np.add.at(joined[i], own, node[i])
        a, b, low, high = own[a[~lasts]], own[b[~lasts]], low[~lasts], high[~lasts]
        a, b, low, high = (c[a != b] for c in (a, b, low, high))
        moving = np.zeros(len(root), dtype=bool)
        moving[a] = moving[b] = True
        report(np.flatnonzero(~moving), joined, joined[1])
        if not len(a):
            break
        wide //= 2
        # node 2n is node n in the first half of its part, 2n + 1 in the second
        half = np.repeat(joined[1] * 2, 2)
        half[1::2] += 1
        ends = []
        for side in (0, 1):
            begins = half[a * 2 + side] * wide
            here = (low < begins + wide) & (high > begins)
            ends.append([a[here] * 2 + side, b[here] * 2 + side, low[here], high[here]])
        a, b, low, high = (np.concatenate(c) for c in zip(*ends, strict=True))
        goes_on = np.zeros(len(half), dtype=bool)
        goes_on[a] = goes_on[b] = True
        twice = [np.repeat(c, 2) for c in joined]
        report(np.flatnonzero(np.repeat(moving, 2) & ~goes_on & (half * wide < steps)), twice, half)
        twice[1] = half
        node = [c[goes_on] for c in twice]
        place = np.cumsum(goes_on) - 1
        a, b = place[a], place[b]
    begin, end, group, size, one, two = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((begin, two, one))
    begin, end, group, size, one, two = (c[order] for c in (begin, end, group, size, one, two))
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (size[1:] != size[:-1]) | (begin[1:] != end[:-1])
    first = np.flatnonzero(fresh)
    final = np.append(first[1:], len(begin))[:len(first)] - 1
    parent, child = np.concatenate(parent), np.concatenate(child)
    order = np.argsort(parent, kind="stable")
    return begin[first], end[final], group[first], size[first], parent[order], child[order]


def _members(group: np.ndarray, users: int, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The users of each group in order, one group after the other."""
    row, done = np.arange(len(group)), []
    while len(group):
        single = group < users
        done.append((row[single], group[single]))
        row, group = row[~single], group[~single]
        first = np.searchsorted(parent, group)
        which, j = _spread(np.searchsorted(parent, group, side="right") - first)
        row, group = row[which], child[first[which] + j]
    row, user = (np.concatenate(c) for c in zip(*done, strict=True))
    return user[np.lexsort((user, row))]

"""Suffix array and common prefixes of one shard by induced sorting with queues that move to disk."""

from __future__ import annotations

import tempfile

import numpy as np

from chronoweave.llm.common import prefix_sums, span_hashes

#: Bytes that the queues of a sort hold in memory; what is above goes to a temporary file of the task.
MEMORY = 64 << 20
#: Common prefixes are counted up to this length, and suffixes ordered by no more characters.
CAP = 100


class Queues:
    """A first-in first-out queue of (position, common prefix with the entry before) for each character.

    The characters are the priorities: the smallest (or largest) queue is emptied first and may grow
    while it is. Entries above the memory bound are kept in a file until their queue's turn comes.
    """

    def __init__(self, memory: int = MEMORY):
        self.parts: dict[int, list] = {}
        self.memory, self.held, self.file = memory, 0, None

    def push(self, c: int, at: np.ndarray, prefix: np.ndarray) -> None:
        if self.held + at.nbytes + prefix.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            where = self.file.seek(0, 2)
            self.file.write(at.tobytes() + prefix.tobytes())
            self.parts.setdefault(c, []).append((where, len(at)))
        else:
            self.held += at.nbytes + prefix.nbytes
            self.parts.setdefault(c, []).append((at, prefix))

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        parts = self.parts.pop(c, None)
        if not parts:
            return None
        out = []
        for a, b in parts:
            if isinstance(a, int):
                self.file.seek(a)
                raw = self.file.read(b * 5)
                a, b = np.frombuffer(raw, np.int32, b), np.frombuffer(raw, np.int8, b, 4 * b)
            else:
                self.held -= a.nbytes + b.nbytes
            out.append((a, b))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


class Shard:
    """text: characters from 1 on, 0 only at the end. After ``sort``: ``suffixes`` in order and ``prefixes``,
    the length (to CAP) that each shares with the one before."""

    def __init__(self, text: np.ndarray, memory: int = MEMORY):
        self.text, self.memory = text, memory
        n = len(text)
        change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
        runs = np.diff(np.append(-1, change))
        rises = np.append(text[change[:-1]] < text[change[:-1] + 1], True)
        self.small = np.repeat(rises, runs)  # S-type
        self.seeds = (np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1).astype(np.int32)
        # the four characters from each place on, in one number
        wide = np.append(text, np.zeros(CAP + 8, text.dtype))
        self.words = wide[3:].astype(np.uint64)
        for part in (wide[2:-1], wide[1:-2], wide[:-3]):
            self.words <<= np.uint64(16)
            self.words |= part

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, compared four characters at a time."""
        out = np.zeros(len(a), np.int64)
        at = np.arange(len(a))
        for step in range(0, CAP, 4):
            if not len(at):
                break
            # a suffix that ends earlier than another differs by then, as the last character is the only 0
            x = self.words[a[at] + step] ^ self.words[b[at] + step]
            equal = x == 0
            rest = x[~equal]
            out[at[~equal]] = step + (rest & np.uint64(0xFFFF) == 0).astype(np.int64) + (rest & np.uint64(0xFFFFFFFF) == 0) + (rest & np.uint64(0xFFFFFFFFFFFF) == 0)
            at = at[equal]
        out[at] = CAP
        return np.minimum(out, CAP).astype(np.int8)

    def _induce_from(self, at: np.ndarray, prefix: np.ndarray, queues: Queues, small: bool) -> None:
        """Send on the suffixes that start one character before; neighbours of a queue share one character more
        than the least of what lies between their sources."""
        places = np.flatnonzero(at > 0)
        before = at[places] - 1
        fits = self.small[before] == small
        places, before = places[fits], before[fits]
        if not len(places):
            return
        first = self.text[before]
        order = np.argsort(first, kind="stable")
        places, before, first = places[order], before[order], first[order]
        cut = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first))
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            own = np.full(b - a, -1, np.int8)
            if self.carry and b - a > 1:
                p = places[a:b]
                least = np.minimum.reduceat(prefix[:p[-1] + 1], p[:-1] + 1)
                own[1:] = np.minimum(least, CAP - 1) + 1
            queues.push(int(first[a]), before[a:b], own)

    def _known(self, at: np.ndarray, prefix: np.ndarray, last: int | None) -> np.ndarray:
        """Fill in the common prefixes that the queues could not carry: where two sources met."""
        if not self.carry:
            return prefix
        prefix = prefix.copy()
        open_ = np.flatnonzero(prefix < 0)
        if len(open_) and open_[0] == 0:
            prefix[0] = 0 if last is None else self.shared(np.array([last]), at[:1])[0]
            open_ = open_[1:]
        prefix[open_] = self.shared(at[open_ - 1], at[open_])
        return prefix

    def _drain(self, c: int, queues: Queues, small: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        out, last = [], None
        while (got := queues.pop(c)) is not None:
            at, prefix = got
            prefix = self._known(at, prefix, last)
            out.append((at, prefix))
            last = int(at[-1])
            self._induce_from(at, prefix, queues, small)
        return out

    def _induce(self, seeds: np.ndarray, prefixes: np.ndarray, carry: bool) -> tuple[np.ndarray, np.ndarray]:
        self.carry = carry
        letters = np.unique(self.text).tolist()
        firsts = self.text[seeds]
        bound = {c: (a, b) for c, a, b in zip(letters, np.searchsorted(firsts, letters).tolist(), np.searchsorted(firsts, letters, "right").tolist(), strict=True)}
        up, large = Queues(self.memory), {}
        for c in letters:
            large[c] = self._drain(c, up, False)
            a, b = bound[c]
            if b > a:
                self._induce_from(seeds[a:b], prefixes[a:b], up, False)
        down, parts = Queues(self.memory), []
        end = len(self.text) - 1
        down.push(int(self.text[end]), np.array([end], np.int32), np.full(1, -1, np.int8))
        for c in reversed(letters):
            own = self._drain(c, down, True)
            if large[c]:
                at, prefix = (np.concatenate([x[i] for x in large[c]]) for i in (0, 1))
                back = np.append(np.int8(-1), prefix[:0:-1])
                self._induce_from(at[::-1], self._known(at[::-1], back, None), down, True)
                own.append((at[::-1], back))
            parts.append(own)
        at = np.concatenate([x for own in parts for x, _ in own])[::-1]
        if not carry:
            return at, np.zeros(0, np.int8)
        prefix = self._known(np.ascontiguousarray(at[::-1]), np.concatenate([x for own in parts for _, x in own]), None)
        return at, np.append(np.int8(0), prefix[:0:-1])

    def sort(self) -> Shard:
        # the order of the pieces between seeds, which names them
        by_letter = self.seeds[np.argsort(self.text[self.seeds], kind="stable")]
        at, _ = self._induce(by_letter, np.zeros(len(by_letter), np.int8), False)
        is_seed = np.zeros(len(self.text), bool)
        is_seed[self.seeds] = True
        at = at[is_seed[at]]
        ends = np.full(len(self.text), len(self.text), np.int64)
        ends[self.seeds[:-1]] = self.seeds[1:] + 1
        sums = prefix_sums(self.text)
        piece, size = span_hashes(sums, at, ends[at]), ends[at] - at
        name = np.cumsum(np.append(True, (piece[1:] != piece[:-1]) | (size[1:] != size[:-1])))
        names = np.zeros(len(self.text), np.int64)
        names[at] = name
        order = self.seeds[sort_names(names[self.seeds])]
        prefixes = np.append(np.int8(0), self.shared(order[:-1], order[1:])) if len(order) else np.zeros(0, np.int8)
        self.suffixes, self.prefixes = self._induce(order, prefixes, True)
        return self


def sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names: pairs of neighbouring names are named in turn, until all differ
    or the names reach beyond CAP characters (each has two of its own at least)."""
    reach, n = 1, len(names)
    while n > 1 and int(names.max()) < n and 2 * reach < CAP + 2:
        after = np.zeros(n, np.int64)
        after[:-reach if reach < n else 0] = names[reach:] if reach < n else 0
        _, inverse = np.unique(names * (int(names.max()) + 1) + after, return_inverse=True)
        names = inverse.astype(np.int64) + 1
        reach *= 2
    return np.argsort(names, kind="stable")

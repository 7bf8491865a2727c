"""Byte-level BPE by distinct matches: each match of the splitting pattern is encoded on its own, so one call of the library
for each distinct match of a step is enough."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

from chronoweave.llm.common import prefix_sums, span_hashes

#: Characters below this code are split here; texts with others go to the library whole.
LIMIT = 0x250
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Distinct matches a worker remembers.
REMEMBERED = 200_000

_far = re.compile(f"[{chr(LIMIT)}-\U0010ffff]")


def _kinds() -> np.ndarray:
    out = np.full(LIMIT, OTHER, np.uint8)
    for c in range(LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


_KIND = _kinds()


def match_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of the pattern start. codes: characters of several texts, each followed by one 0 character,
    which is its own match; first: where each text starts."""
    n = len(codes)
    kind = _KIND[codes]
    ends = np.append(first[1:], n) - 1
    kind[ends] = 9
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[first] = True
    # the last character of a run of white space before a word: a space joins the word, another stands alone
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < 9) & (kind[1:] != SPACE))
    start[last] = True
    joined = last[codes[last] == 32]
    start[joined + 1] = False
    # contractions: a single quote that starts a match, then s, t, m, d, re, ve or ll
    quote = np.flatnonzero((codes == 39) & start[:-1])
    if len(quote):
        pad = np.append(codes, [0, 0, 0])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for at, size in ((quote[one], 1), (quote[two & ~one], 2)):
            start[at + 1] = False
            start[at + 1 + size] = True
    return np.flatnonzero(start[:n])


class Matches:
    """Encodes lists of texts; ``encode`` gives the ids of many whole texts, ``encode_matches`` those of single matches.
    Texts that hold one of ``whole`` are not split here."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], encode_matches: Callable[[list[str]], list[list[int]]] | None = None, whole: list[str] | None = None):
        self.encode, self.encode_matches = encode, encode_matches or encode
        self.whole = re.compile("|".join(map(re.escape, whole))) if whole else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def _places(self, matches: list[str]) -> np.ndarray:
        """Where the ids of each match begin."""
        if len(self.known) + len(matches) > REMEMBERED:
            self._clear()
        new = list(dict.fromkeys(m for m in matches if m not in self.known))
        if new:
            found = self.encode_matches(new)
            at = len(self.offsets) - 1
            self.known.update(zip(new, range(at, at + len(new))))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter((x for f in found for x in f), np.int32, int(sizes.sum()))])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.known.__getitem__, matches), np.int64, len(matches))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        far = [i for i, t in enumerate(texts) if not t.isascii() and _far.search(t) or self.whole and self.whole.search(t)]
        skip = set(far)
        near = ["" if i in skip else t for i, t in enumerate(texts)] if far else texts
        ids, sizes = self._near(near)
        if not far:
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i, own in zip(far, self.encode([texts[i] for i in far]), strict=True):
            parts[i] = np.array(own, np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _near(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=first[1:])
        starts = match_starts(codes, first)
        ends = np.append(starts[1:], len(codes))
        closing = np.append(first[1:], len(codes)) - 1
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, closing)] = False
        counts = np.diff(np.append(np.searchsorted(starts, first), len(starts))) - 1
        starts, ends = starts[real], ends[real]
        _, where, inverse = np.unique(span_hashes(prefix_sums(codes), starts, ends), return_index=True, return_inverse=True)
        some = [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        if same_spans(codes, starts, ends, starts[where][inverse], ends[where][inverse]):
            places = self._places(some)[inverse]
        else:  # two matches with one hash
            places = self._places([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        sizes = self.offsets[places + 1] - self.offsets[places]
        return gather(self.ids, self.offsets[places], sizes), group_sums(sizes, counts)


def same_spans(codes: np.ndarray, first: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> bool:
    """Whether all spans [first, end) read as the other ones do."""
    sizes = end - first
    if not bool((sizes == other_end - other).all()):
        return False
    if len(codes) and int(codes.max()) < 1 << 16:
        # four characters a number, as many numbers of a span as it has
        fours = np.concatenate([codes, np.zeros(4, codes.dtype)]).astype(np.uint64)
        fours = fours[:-3] | fours[1:-2] << np.uint64(16) | fours[2:-1] << np.uint64(32) | fours[3:] << np.uint64(48)
        masks = np.array([0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF], np.uint64)
        apart = np.flatnonzero((first != other) & (sizes > 0))
        at, to, left = first[apart], other[apart], sizes[apart]
        while len(left):
            if ((fours[at] ^ fours[to]) & masks[np.minimum(left, 4)]).any():
                return False
            more = left > 4
            at, to, left = at[more] + 4, to[more] + 4, left[more] - 4
        return True
    return bool((gather(codes, first, sizes) == gather(codes, other, sizes)).all())


def gather(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of values[first[i]:first[i] + sizes[i]]."""
    total = int(sizes.sum())
    shift = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    return values[shift + np.arange(total)]


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]

"""Elias-Fano sequences in numpy, and a three-level n-gram trie made of them.

A non-decreasing sequence is kept as packed low bits and a unary bit vector of the high
parts with a running count per word: about 2 + log2(universe / length) bits per value, read at
any place in a few word operations.  All calls take arrays of places or targets.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Every so many values one is kept plain, so that a successor search starts in a short stretch.
SAMPLED = 8
#: SELECT[byte, k]: place of the k-th set bit of a byte.
SELECT = np.zeros((256, 8), dtype=np.uint8)
for _byte in range(256):
    _set = [b for b in range(8) if _byte >> b & 1]
    SELECT[_byte, :len(_set)] = _set


def _words(bits: np.ndarray) -> np.ndarray:
    """A boolean array as 64-bit words, lowest bit first, with a spare word at the end."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)]).view(U64)


class EliasFano:
    """``parts`` are the arrays that hold the sequence; they may be memory-mapped."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, dtype=U64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // self.n).bit_length() - 1) if self.n else 0
        l = self.low_bits
        low = np.empty((self.n, l), dtype=bool)
        for k in range(l):  # one bit at a time, so the bits of all values are never whole words
            low[:, k] = (values >> U64(k)) & U64(1)
        high = np.zeros(self.n + (top >> l) + 1, dtype=bool)
        high[(values >> U64(l)).astype(np.int64) + np.arange(self.n)] = True
        words = _words(high)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]).astype(np.uint32)
        self.parts = [_words(low.ravel()), words, before, values[::SAMPLED].copy()]

    def _select(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th set bit of the high parts."""
        _, words, before, _ = self.parts
        at = np.searchsorted(before, i.astype(np.uint32), side="right") - 1
        word, left = words[at], (i - before[at]).astype(U64)
        place = np.zeros(len(i), dtype=U64)
        for width in (32, 16, 8):
            half = np.bitwise_count((word >> place) & U64((1 << width) - 1)).astype(U64)
            beyond = left >= half
            left = np.where(beyond, left - half, left)
            place = np.where(beyond, place + U64(width), place)
        place += SELECT[((word >> place) & U64(255)).astype(np.int64), left.astype(np.int64)]
        return at.astype(U64) * U64(64) + place

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.empty(0, dtype=U64)
        high = self._select(i) - i.astype(U64)
        l = self.low_bits
        if not l:
            return high
        first = i.astype(U64) * U64(l)
        word, shift = (first >> U64(6)).astype(np.int64), first & U64(63)
        lows = self.parts[0]
        low = lows[word] >> shift
        over = shift + U64(l) > U64(64)
        low[over] |= lows[word[over] + 1] << (U64(64) - shift[over])
        return (high << U64(l)) | (low & U64((1 << l) - 1))

    def find(self, low: np.ndarray, high: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place in [low, high) whose value is not below the target (successor search); high if none."""
        # the whole sequence rises, so the answer lies between two plain values, and in the range asked for
        step = np.searchsorted(self.parts[3], target).astype(np.int64) * SAMPLED
        start, end = low.astype(np.int64), high.astype(np.int64)
        low, high = np.clip(step - SAMPLED + 1, start, end), np.clip(step, start, end)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            below = self.get(middle) < target[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        return low


class Relative:
    """Successor words of contexts: inside a context's run they rise, and each run is laid on the end of the one before."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        last = np.zeros(len(starts) - 1, dtype=U64)
        full = np.flatnonzero(np.diff(starts))
        last[full] = words[starts[full + 1] - 1]
        base = np.concatenate([[U64(0)], np.cumsum(last)]).astype(U64)
        self.values = EliasFano(words.astype(U64) + np.repeat(base[:-1], np.diff(starts)))
        self.starts = EliasFano(starts)

    def find(self, context: np.ndarray, word: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Place of each word after its context, -1 if it never follows it.

        ``which`` says for each word where its context stands in ``context``; one of -1 has no successors.
        """
        low, high = np.zeros(len(context), dtype=np.int64), np.zeros(len(context), dtype=np.int64)
        base = np.zeros(len(context), dtype=U64)
        known = np.flatnonzero(context >= 0)
        low[known] = self.starts.get(context[known])
        high[known] = self.starts.get(context[known] + 1)
        later = np.flatnonzero(low > 0)
        base[later] = self.values.get(low[later] - 1)
        target = base[which] + word.astype(U64)
        at = self.values.find(low[which], high[which], target)
        found = np.full(len(word), -1, dtype=np.int64)
        inside = np.flatnonzero(at < high[which])
        hit = inside[self.values.get(at[inside]) == target[inside]]
        found[hit] = at[hit]
        return found


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and for each element which of them it is."""
    new = np.append(True, values[1:] != values[:-1])[:len(values)]
    return values[new], np.cumsum(new) - 1


class Trie:
    """First words, their second words with two codes each, and third words with one code each.

    ``pairs`` (first << width | second) and ``triples`` (pair << width | third) are sorted and distinct; the
    pair of each triple is among the pairs.  With ``owner``, the place of each triple's pair, triples need only end in their third word.
    """

    def __init__(self, pairs: np.ndarray, triples: np.ndarray, width: int, codes2: np.ndarray, more2: np.ndarray,
                 codes3: np.ndarray, owner: np.ndarray | None = None):
        mask = U64((1 << width) - 1)
        first, starts1 = np.unique(pairs >> U64(width), return_index=True)
        owner = np.searchsorted(pairs, triples >> U64(width)) if owner is None else owner
        starts2 = np.searchsorted(owner, np.arange(len(pairs) + 1))
        self.width, self.mask = width, mask
        self.first = EliasFano(first)
        self.second = Relative(pairs & mask, np.append(starts1, len(pairs)))
        self.third = Relative(triples & mask, starts2)
        self.codes = [codes2, more2, codes3]

    def sequences(self) -> list[EliasFano]:
        return [self.first, self.second.values, self.second.starts, self.third.values, self.third.starts]

    def mapped(self, folder: str) -> "Trie":
        """The same trie with its levels in one memory-mapped file."""
        arrays = [(s.parts, k) for s in self.sequences() for k in range(4)] + [(self.codes, k) for k in range(3)]
        name = tempfile.NamedTemporaryFile(dir=folder, delete=False).name
        places, end = [], 0
        with open(name, "wb") as f:
            for owner, k in arrays:
                f.write(owner[k].tobytes())
                f.write(bytes(-owner[k].nbytes % 8))
                places.append(end)
                end += owner[k].nbytes + -owner[k].nbytes % 8
        for (owner, k), place in zip(arrays, places):
            if owner[k].size:
                owner[k] = np.memmap(name, dtype=owner[k].dtype, mode="r", offset=place, shape=owner[k].shape)
        return self

    def pair(self, pairs: np.ndarray) -> np.ndarray:
        """Place of each of some sorted pairs in level two, -1 if absent."""
        first, which = runs(pairs >> U64(self.width))
        n = len(first)
        at = self.first.find(np.zeros(n, dtype=np.int64), np.full(n, self.first.n, dtype=np.int64), first)
        inside = np.flatnonzero(at < self.first.n)
        context = np.full(n, -1, dtype=np.int64)
        hit = inside[self.first.get(at[inside]) == first[inside]]
        context[hit] = at[hit]
        return self.second.find(context, pairs & self.mask, which)


def blocks(sorted_by: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    if len(sorted_by):
        cuts = np.flatnonzero(np.diff(sorted_by)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(sorted_by)]):
            yield int(sorted_by[low]), slice(int(low), int(high))

"""A run-length index: a run-compressed Burrows-Wheeler transform with samples at the ends of its runs.

The transform of a repetitive text has few runs.  Kept are, of each run, its
symbol and length, the text positions of its first and last entry, and how long
the first entry's suffix agrees with the one before it in order (and the order
itself, for questions about who else has a string).  That is enough to stream the text's statistics: where the transform goes on with a run, the
agreement with the neighbour at one position is that of the position before,
less one.  So the length of the longest match that a position has anywhere else
comes from the samples and a running count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _bits(text: np.ndarray) -> int:
    return max(1, int(text.max()).bit_length())


def _packed(text: np.ndarray) -> tuple[np.ndarray, int]:
    """As many symbols from each position on as one number holds, zeros after the end; and how many they are."""
    bits = _bits(text)
    many = 64 // bits
    padded = np.zeros(len(text) + many, np.uint64)
    padded[: len(text)] = text
    out = np.zeros(len(text), np.uint64)
    for i in range(many):
        out = (out << np.uint64(bits)) | padded[i : i + len(text)]
    return out, many


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order: by some symbols first, then by prefix doubling of those still equal."""
    n = len(text)
    key, step = _packed(text)
    order = np.argsort(key)
    rank, tied = _ranks(order, key, np.zeros(n, np.int64), np.arange(n))
    while len(tied) and step < n:
        # only what still has an equal is sorted again, within its place
        at = tied
        ahead = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        sub = rank[at] * (n + 1) + ahead
        by = np.argsort(sub)
        rank, tied = _ranks(at[by], sub[by], rank, np.sort(rank[at]), sorted_keys=True)
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _ranks(order: np.ndarray, key: np.ndarray, rank: np.ndarray, places: np.ndarray, sorted_keys: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """New ranks of the suffixes ``order``: that of the first of their equals; and those that have equals."""
    k = key if sorted_keys else key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(k)])))
    if sorted_keys:
        # places: the old ranks in order; a suffix's new rank is its old one plus how many of its old group are below it
        start = np.concatenate(([True], places[1:] != places[:-1]))
        begin = np.flatnonzero(start)[np.cumsum(start) - 1]
        value = places + np.arange(len(places)) - begin
    else:
        value = places
    rank = rank.copy()
    rank[order] = value[first][group]
    return rank, order[size[group] > 1]


@dataclass
class RunLengthIndex:
    size: int
    heads: np.ndarray  #: symbol of each run
    lengths: np.ndarray
    first: np.ndarray  #: text position of each run's first entry
    last: np.ndarray  #: and of its last one
    agreement: np.ndarray  #: of each run's first entry with the entry before it
    order: np.ndarray  #: text positions of all entries

    @classmethod
    def build(cls, text: np.ndarray) -> RunLengthIndex:
        """``text``: symbols from 0 on; its last one should occur once."""
        text = np.asarray(text, np.uint64)
        n = len(text)
        if not n:
            none = np.zeros(0, np.int64)
            return cls(0, none, none, none, none, none, none)
        sa = suffix_array(text)
        bwt = text[sa - 1].astype(np.int64)  # the last symbol stands before the text's beginning
        start = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        stop = np.concatenate((start[1:], [n])) - 1
        agreement = np.zeros(len(start), np.int64)
        agreement[1:] = _agreement(text, sa[start[1:] - 1], sa[start[1:]])
        return cls(n, bwt[start], stop - start + 1, sa[start], sa[stop], agreement, sa)

    def longest_elsewhere(self, again: np.ndarray | None = None) -> np.ndarray:
        """For each text position the length of the longest string that starts there and also elsewhere.

        ``again``: what is known of each position beforehand, as the index holds one entry for several copies.
        """
        after = np.append(self.agreement[1:], 0)  # of each run's last entry with the entry after it
        out = np.maximum(self._streamed(self.first, self.agreement), self._streamed(self.last, after))
        return out if again is None else np.maximum(out, again)

    def in_others(self, owner: np.ndarray, size: int, several: np.ndarray) -> np.ndarray:
        """For each text position whether the ``size`` symbols from there on also start at a position of another owner.

        ``several``: positions that stand for several owners.
        """
        before = self._streamed(self.first, self.agreement)[self.order]
        start = np.flatnonzero(np.append(True, before[1:] < size))  # equal strings are side by side
        own = owner[self.order]
        mixed = (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)) | np.logical_or.reduceat(several[self.order], start)
        out = np.empty(self.size, bool)
        out[self.order] = np.repeat(mixed, np.diff(np.append(start, self.size)))
        return out

    def _streamed(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Values sampled at text positions, each going down by one at each position until the next sample."""
        sampled = np.zeros(self.size, np.int64)
        known = np.full(self.size, -1, np.int64)
        sampled[at] = value
        known[at] = at
        since = np.maximum.accumulate(known)
        return np.maximum(sampled[since] - (np.arange(self.size) - since), 0)

    def occurrences(self, pattern: list[int]) -> int:
        """How often a string occurs: a step from last to first on the runs for each symbol, from the string's end on."""
        below, before = self._steps()
        low, high = 0, self.size
        for symbol in reversed(pattern):
            low, high = (below.get(symbol, 0) + self._rank(symbol, at, before) for at in (low, high))
            if low >= high:
                return 0
        return high - low

    def _steps(self) -> tuple[dict[int, int], np.ndarray]:
        """How many entries sort before each symbol's, and where each run begins."""
        names, of = np.unique(self.heads, return_inverse=True)
        many = np.bincount(of, weights=self.lengths, minlength=len(names)).astype(np.int64)
        return dict(zip(names.tolist(), (np.cumsum(many) - many).tolist(), strict=True)), np.cumsum(self.lengths) - self.lengths

    def _rank(self, symbol: int, at: int, before: np.ndarray) -> int:
        """How often the symbol stands in the transform before a place."""
        own = self.heads == symbol
        return int(np.clip(at - before[own], 0, self.lengths[own]).sum())


def _agreement(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols two suffixes have in common, for pairs of suffixes."""
    n = len(text)
    packed, many = _packed(text)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = np.maximum(x, y) + many <= n
        same = inside & (packed[np.minimum(x, n - 1)] == packed[np.minimum(y, n - 1)])
        out[live[same]] += many
        live = live[same]
    same = np.ones(len(a), bool)
    for _ in range(many - 1):
        x, y = a + out, b + out
        same &= (np.maximum(x, y) < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        out += same
    return out

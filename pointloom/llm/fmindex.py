"""A full-text index of numbers in little memory: suffix order, wavelet tree, backward search, sampled positions.

The text is an array of symbols from 1 up, with 0 between its stretches; phrases hold no 0. All
methods take arrays of phrases or places and work on all of them at once.

Defined cases: an empty text holds nothing; an empty phrase is refused; symbols that the text lacks end a search.
"""

from __future__ import annotations

import numpy as np

#: A suffix position is kept for each of so many places of the text, and behind each 0.
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order; each 0 counts as smaller than the zeros behind it.

    Ranks by 1, 2, 4, ... symbols; only suffixes that share their rank with others are sorted again.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    held = rank[order]
    first = np.r_[True, held[1:] != held[:-1]] if n else np.zeros(0, bool)
    # a suffix's rank is where its group of equals begins
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    at, step = np.flatnonzero(~(first & np.r_[first[1:], True])) if n else np.zeros(0, np.int64), 1
    while len(at):
        own, group = order[at], starts[at]
        behind = np.where(own + step < n, rank[np.minimum(own + step, n - 1)], -1)
        turn = np.lexsort((behind, group))
        own, behind = own[turn], behind[turn]
        order[at] = own
        new = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        starts[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[own] = starts[at]
        at = at[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


class Bits:
    """Bits with their number of ones before any place: one count for each 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        self.words = np.packbits(np.r_[bits, np.zeros(64 + -len(bits) % 64, bool)], bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are 1."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Symbols by their bits, highest first; on each level those with a 0 come before those with a 1, else in their order."""

    def __init__(self, symbols: np.ndarray, most: int) -> None:
        self.levels, self.zeros = [], []
        own = symbols
        for level in range(max(1, int(most).bit_length()) - 1, -1, -1):
            bits = own >> level & 1 == 1
            self.levels.append((level, Bits(bits)))
            self.zeros.append(len(own) - int(bits.sum()))
            own = np.r_[own[~bits], own[bits]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``."""
        start = np.zeros_like(at)
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = symbol >> level & 1 == 1
            a, b = bits.ones(start), bits.ones(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how many equal ones come before each."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one, a, b = bits.get(at), bits.ones(start), bits.ones(at)
            symbol += one.astype(np.int64) << level
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return symbol, at - start


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        """Index of ``text``, an array of symbols from 0 up; one that does not end with 0 is taken with a 0 behind it."""
        if len(text) and text[-1]:
            text = np.r_[text, 0]
        self.size = len(text)
        if not self.size:
            return
        order = suffix_order(text)
        ahead = text[order - 1].astype(np.int64)  # symbol before each suffix; before the first is the last
        ahead[order == 0] = 0
        most = int(text.max())
        self.tree = Wavelet(ahead, most)
        #: Where the suffixes that begin with each symbol begin.
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=most + 1))].astype(np.int64)
        kept = (order % sample == 0) | (ahead == 0)
        self.kept, self.places = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length (rows), the first suffix that begins with each, and one past the last."""
        n = len(phrases)
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        if not self.size:
            return low, low.copy()
        if not phrases.shape[1]:
            raise ValueError("an empty phrase is everywhere")
        live = np.arange(n)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k].astype(np.int64)
            known = (symbol > 0) & (symbol < len(self.starts) - 1)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            begin = self.starts[symbol]
            low[live], high[live] = begin + self.tree.rank(symbol, low[live]), begin + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes, by steps back to one whose place is kept."""
        out, at, back = np.zeros(len(rows), np.int64), rows.astype(np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            here = self.kept.get(at)
            out[live[here]] = self.places[self.kept.ones(at[here])] + back
            live, at = live[~here], at[~here]
            symbol, equal = self.tree.get(at)
            at, back = self.starts[symbol] + equal, back + 1
        return out

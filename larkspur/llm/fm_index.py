"""A compressed full-text index of one shard: a Burrows-Wheeler transform in a wavelet matrix of packed bits, and a
sample of the suffix array."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions sorted by the suffixes that begin there (prefix doubling). Zeros differ from each other by position."""
    n = len(symbols)
    zero = symbols == 0
    rank = symbols + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    rank, k = np.unique(rank, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < n and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        rank[order] = np.cumsum(np.diff(both[order], prepend=both[order[0]]) != 0)
        k *= 2
    return order


class Bits:
    """A bit vector in 64-bit words, with a count before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Index of `symbols`, where 0 ends each unit. Of the suffix array only unit begins and every `step`-th position are kept."""

    def __init__(self, symbols: np.ndarray, step: int = 8):
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.bits_of_symbol = max(1, int(symbols.max(initial=1)).bit_length())
        last = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max(initial=1)) + 1))])
        self.levels, self.zeros = [], []
        for level in range(self.bits_of_symbol - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            last = np.concatenate([last[~bit], last[bit]])
        every = np.arange(len(self.first) - 1)
        self.start = self._descend(every, np.zeros_like(every))
        begins = np.concatenate([[True], symbols[:-1] == 0])
        kept = (begins | (np.arange(self.size) % step == 0))[order]
        self.kept, self.sample = Bits(kept), order[kept].astype(np.int32)

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where(c >> (self.bits_of_symbol - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the ranges of suffixes that begin with c and go on as those of [low, high) do."""
        base = self.first[c] - self.start[c]
        return base + self._descend(c, low), base + self._descend(c, high)

    def back(self, i: np.ndarray) -> np.ndarray:
        """Where the suffixes that begin one symbol earlier stand; not for unit begins."""
        c, at = np.zeros_like(i), i
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            c = c << 1 | one
        return self.first[c] - self.start[c] + at

    def locate(self, i: np.ndarray) -> np.ndarray:
        """The positions of suffixes, by stepping back to sampled ones."""
        out, at, todo, steps = np.zeros(len(i), np.int64), i.copy(), np.arange(len(i)), 0
        while len(todo):
            hit = self.kept.get(at)
            out[todo[hit]] = self.sample[self.kept.rank(at[hit])] + steps
            todo, at, steps = todo[~hit], self.back(at[~hit]), steps + 1
        return out

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first position in each range, none of them empty; equal ranges are located once."""
        ranges, which = np.unique(low * np.int64(self.size + 1) + high, return_inverse=True)
        low, high = ranges // (self.size + 1), ranges % (self.size + 1)
        n = high - low
        begin = np.cumsum(n) - n
        rows = np.repeat(low - begin, n) + np.arange(int(n.sum()))
        return np.minimum.reduceat(self.locate(rows), begin)[which] if len(n) else low

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text: (length, low, high) for each of `ends`.

        length is that of the longest text[end - length : end], up to `most`, that the index holds, or holds more than
        once where `others` says that the text itself is in the index; low and high are its range of suffixes.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        need = np.where(others, 2, 1)
        alive = np.arange(len(ends))
        for k in range(most):
            c = text[ends[alive] - k - 1]
            a, z = self.extend(c, low[alive], high[alive])
            on = (z - a >= need[alive]) & (c > 0)
            alive = alive[on]
            low[alive], high[alive], length[alive] = a[on], z[on], k + 1
            if not len(alive):
                break
        return length, low, high

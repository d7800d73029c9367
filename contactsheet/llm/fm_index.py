"""A full-text index of sequences of symbols in numpy: suffix array, wavelet matrix over its transform, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """The order of the suffixes. rank: numbers whose last one is unique."""
    n, step = len(rank), 1
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]), dtype=np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class Wavelet:
    """Ranks and symbols of a sequence, by bits from the highest."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before a position."""
        start = np.zeros_like(at)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - i)) & 1 == 1
            at = np.where(bit, zeros + ones[at], at - ones[at])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
            out = 2 * out + bit
        return out


class FMIndex:
    """Runs of symbols (1 and more), each ended by a 0; no match goes over an end."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, top: int):
        text = text.astype(np.int64)
        ends = text == 0
        self.n, n_ends = len(text), int(ends.sum())
        order = suffix_array(np.where(ends, np.cumsum(ends) - 1, text + n_ends))
        last = text[order - 1]  # of the first place, the last end
        self.last = Wavelet(last, top)
        counts = np.bincount(text, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: top + 2].astype(np.int64)
        self.sampled = (order % self.SAMPLE == 0) | (last == 0)
        self.places = order[self.sampled]
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns of one length, a row each: the range of suffixes that start with each."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            if not len(alive):
                break
            c = patterns[alive, column].astype(np.int64)
            lo[alive] = self.first[c] + self.last.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.last.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of some suffixes: steps to the left until a sampled one."""
        rows, out, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            done = self.sampled[at]
            out[todo[done]] = self.places[self.before[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.last.symbol(at)
            rows[todo] = self.first[c] + self.last.rank(c, at)
            steps += 1
        return out

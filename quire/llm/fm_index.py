"""An FM-index over a sequence of small integers, with NumPy: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of the suffixes by prefix doubling; each 0 is an end of its own, smaller than those after it."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class WaveletTree:
    """Ranks of symbols: a bit plane for each level, with the ones before each place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first = np.zeros(len(place), np.int64)
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = ones[first], ones[place]
            first, place = np.where(one, zeros + a, first - a), np.where(one, zeros + b, place - b)
        return place - first


class FMIndex:
    """Of symbols >= 1 in runs that each end in a 0."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.tree = WaveletTree(self.last, max(1, int(symbols.max()).bit_length()))
        starts = np.ones(len(symbols), bool)
        starts[1:] = symbols[:-1] == 0
        # Every run's first place is kept, so that no walk leaves its run.
        self.kept = starts[order] | (order % sample == 0)
        self.position = np.where(self.kept, order, -1)

    def _back(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, place)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase (a row, filled up with 0 on the right)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last))
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            now = alive[lengths[alive] > k]
            symbol = phrases[now, k]
            known = symbol < len(self.before) - 1
            high[now[~known]] = low[now[~known]] = 0
            now, symbol = now[known], symbol[known]
            low[now], high[now] = self._back(symbol, low[now]), self._back(symbol, high[now])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """The position of each suffix, by walking back to a kept one."""
        out, steps = np.full(len(places), -1), 0
        todo, at = np.arange(len(places)), places
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.position[at[done]] + steps
            todo, at = todo[~done], at[~done]
            at = self._back(self.last[at], at)
            steps += 1
        return out

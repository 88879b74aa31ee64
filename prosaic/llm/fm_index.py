"""An FM-index over an array of symbols: wavelet matrix of the Burrows-Wheeler transform and sampled suffix positions.

All queries are answered for whole arrays of patterns at a time.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by doubling the compared prefix; a suffix that ends is smaller."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        key = rank << 32
        if width < n:
            key[: n - width] |= rank[width:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if n == 0 or new[order[-1]] == n:
            return order
        rank, width = new, width * 2


class FMIndex:
    """symbols: values in [0, size)."""

    def __init__(self, symbols: np.ndarray, size: int):
        text = np.append(symbols.astype(np.int64) + 1, 0)  # 0 ends the text
        order = suffix_array(text)
        last = text[order - 1]  # the transform; before the first suffix stands the end
        self.n = len(text)
        self.levels = max(1, int(size).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        self.ones, self.zeros = [], []
        column = last
        for level in reversed(range(self.levels)):
            bit = ((column >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            column = np.concatenate([column[~bit], column[bit]])
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.before = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.positions = order[sampled]
        self.start = self._descend(np.arange(size + 1), np.zeros(size + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, level in enumerate(reversed(range(self.levels))):
            one = self.ones[depth][at]
            at = np.where((symbol >> level) & 1, self.zeros[depth] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._descend(symbol, at) - self.start[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of patterns, from its last symbol to its first, the range of suffixes that begin with it."""
        symbols = patterns.astype(np.int64) + 1
        low, high = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.n, np.int64)
        live = np.arange(len(symbols))
        for j in reversed(range(symbols.shape[1])):
            c = symbols[live, j]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            dead = live[low[live] >= high[live]]
            low[dead] = high[dead] = 0
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of those rows begin: steps back until a sampled one."""
        at, out, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            known = self.sampled[at]
            out[live[known]] = self.positions[self.before[at[known]]] + steps
            live, at = live[~known], at[~known]
            symbol, place = np.zeros(len(at), np.int64), at
            for depth in range(self.levels):
                ones = self.ones[depth]
                bit = ones[place + 1] - ones[place]
                symbol = symbol << 1 | bit
                place = np.where(bit == 1, self.zeros[depth] + ones[place], place - ones[place])
            at = self.first[symbol] + place - self.start[symbol]
            steps += 1
        return out

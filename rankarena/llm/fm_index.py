"""An FM-index over a sequence of integers: suffix array, wavelet-tree ranks and sampled suffix positions."""

import numpy as np

#: Every how many places of the text a suffix position is kept.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. The last symbol must be the smallest and occur once."""
    size = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(size, np.int64)
        after[: size - step] = rank[step:] + 1
        key = rank * (size + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(size, np.int64)
        rank[order] = new
        if new[-1] == size - 1:
            return order
        step *= 2


class Bits:
    """A bit vector with counts of ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word, place = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << place) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol, all nodes of a level side by side."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.size = len(symbols)
        self.depth = max(1, int(symbols.max()).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for bit in range(self.depth - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append((Bits(ones), int(self.size - ones.sum())))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        self.first = self._down(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones_before(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        """``text``: whole numbers from 0 on, dense enough for counts of each; the last one, 0, occurs only there."""
        order = suffix_array(text)
        self.size = len(text)
        self.last_column = text[order - 1]
        self.tree = WaveletTree(self.last_column)
        counts = np.bincount(text, minlength=1 << self.tree.depth)
        self.smaller = np.concatenate(([0], np.cumsum(counts)))
        self.sampled = Bits(order % sample == 0)
        self.positions = order[order % sample == 0]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase. A row of ``phrases`` has its symbols from the last one on."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] if len(phrases) else 0):
            live = live[lengths[live] > k]
            symbol = phrases[live, k]
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of these suffixes: step back through the text to a kept position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows]) if len(rows) else np.zeros(0, np.int64)
        while len(live):
            symbol = self.last_column[rows[live]]
            rows[live] = self.smaller[symbol] + self.tree.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.positions[self.sampled.ones_before(rows)] + steps

"""FM-index over sequences of whole numbers, with numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, n_sep: int) -> np.ndarray:
    """Suffix array by prefix doubling. Symbols below n_sep occur once each, so suffixes that reach one end there; only suffixes that still tie are sorted again."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    head = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = start
    while True:
        single = np.concatenate([head[1:], [True]]) & head
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        at = order[open_]
        nxt = at + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        place = np.lexsort((second, rank[at]))
        at, first, second = at[place], rank[at][place], second[place]
        order[open_] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[open_] = new
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        k *= 2


class WaveletTree:
    """Levels of a balanced wavelet tree (as a matrix: zeros of a level before its ones), each a bit vector with counts of ones before each 64 bits."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        self.n, self.levels = len(text), []
        self.depth = max(int(n_symbols - 1).bit_length(), 1)
        for level in reversed(range(self.depth)):
            bit = ((text >> level) & 1).astype(np.uint8)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = int(self.n - bit.sum(dtype=np.int64))
            self.levels.append((words, before, zeros))
            text = np.concatenate([text[bit == 0], text[bit == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros_like(at)
        for level, (words, before, zeros) in zip(reversed(range(self.depth)), self.levels, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            ones_low, ones_at = self._ones(words, before, low), self._ones(words, before, at)
            low = np.where(one, zeros + ones_low, low - ones_low)
            at = np.where(one, zeros + ones_at, at - ones_at)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it occurs before."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for level, (words, before, zeros) in zip(reversed(range(self.depth)), self.levels, strict=True):
            ones_low, ones_at = self._ones(words, before, low), self._ones(words, before, at)
            one = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            symbol |= one.astype(at.dtype) << level
            low = np.where(one, zeros + ones_low, low - ones_low)
            at = np.where(one, zeros + ones_at, at - ones_at)
        return symbol, at - low


class FMIndex:
    """Index of fragments of symbols 1 and up, which 0 separates (and ends).

    Every ``sample``-th position of a fragment, its first one too, keeps its place in the text; other occurrences are
    located by stepping back to one.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 16):
        gaps = np.flatnonzero(text == 0)
        unique = text.astype(np.int64) + len(gaps)
        unique[gaps] = np.arange(len(gaps))
        order = suffix_array(unique, len(gaps))
        bwt = text[order - 1].astype(np.int64)
        self.tree = WaveletTree(bwt, n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))]).astype(np.int64)
        in_fragment = np.arange(len(text)) - np.maximum.accumulate(np.where(np.concatenate([[True], text[:-1] == 0]), np.arange(len(text)), 0))
        kept = (in_fragment % sample == 0)[order]
        self.kept, self.place = kept, order[kept]
        self.kept_before = np.cumsum(kept) - kept

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of equal length) at once: the ranges of suffixes that start with each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.tree.n, np.int64)
        alive = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j]
            a = self.before[c] + self.tree.rank(c, low[alive])
            b = self.before[c] + self.tree.rank(c, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[a < b]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows start."""
        out, rows, todo, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            here = self.kept[rows[todo]]
            done = todo[here]
            out[done] = self.place[self.kept_before[rows[done]]] + steps
            todo = todo[~here]
            symbol, earlier = self.tree.access(rows[todo])
            rows[todo] = self.before[symbol] + earlier
            steps += 1
        return out

"""FM-index of a shard of word sequences: truncated alphabets, a wavelet matrix for ranks, sampled suffix positions.

Numpy helpers for use inside tasks. The alphabet is the phrases' vocabulary (1 to v); every other word, and the end of
every document, is a separator (0). Each separator is a symbol of its own, smaller than all words and ordered by position,
so suffixes part at the next separator at the latest and sorting never runs through long copies.
"""

from __future__ import annotations

import numpy as np

#: Positions that are multiples of this are sampled, besides all that follow a separator.
SAMPLE = 16


def suffix_array(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Positions of words (where text > 0) in the order of their suffixes. text ends with a separator."""
    n = len(text)
    separators = n - len(words)
    rank = np.empty(n + 32, dtype=np.int64)
    rank[:n] = text + separators  # words after all separators
    rank[:n][text == 0] = np.arange(separators)
    rank[n:] = 0
    bits = int(rank.max()).bit_length()
    width = max(1, 63 // max(bits, 1))
    key = rank[words].copy()
    stop = text[words] == 0
    for i in range(1, min(width, 4)):
        at = words + i
        stop = stop | (text[np.minimum(at - 1, n - 1)] == 0)  # nothing counts behind a separator
        key = (key << bits) | np.where(stop, 0, rank[np.minimum(at, n - 1)])
    depth = min(width, 4)
    order = np.argsort(key, kind="stable")
    sa = words[order]
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    group = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))
    place = np.empty(n + 32, dtype=np.int64)  # of words: separators + the first row of their group; of separators: their number
    place[:n] = rank[:n]
    place[sa] = separators + group
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(tied):
        pos = sa[tied]
        # a group's members hold depth words each, without a separator: else they had differed
        key2 = place[np.minimum(pos + depth, n - 1)]
        g = group[tied]
        order = np.lexsort((key2, g))
        sa[tied] = pos = pos[order]
        g, key2 = g[order], key2[order]
        new_head = np.concatenate(([True], (g[1:] != g[:-1]) | (key2[1:] != key2[:-1])))
        first = np.maximum.accumulate(np.where(new_head, tied, 0))
        group[tied] = first
        place[pos] = separators + first
        still = ~(new_head & np.append(new_head[1:], True))
        tied = tied[still]
        depth *= 2
    return sa


class FMIndex:
    """Counts and locates phrases of words in text (int array, 0 for separators)."""

    def __init__(self, text: np.ndarray, vocabulary: int):
        text = np.append(text, 0).astype(np.int64)
        words = np.flatnonzero(text)
        self.size = len(words)
        if not self.size:
            return
        sa = suffix_array(text, words)
        before = text[np.maximum(sa - 1, 0)]
        before[sa == 0] = 0
        ends = np.flatnonzero((text[1:] == 0) & (text[:-1] > 0)) + 1
        # rows of separators that follow a word come first; the others hold no word and count for no rank
        bwt = np.concatenate((text[ends - 1], before))
        self.offset = len(ends)
        self.sa_sampled = np.concatenate((np.zeros(self.offset, dtype=bool), (before == 0) | (sa % SAMPLE == 0)))
        self.sampled_rank = np.concatenate(([0], np.cumsum(self.sa_sampled)))
        self.samples = sa[(before == 0) | (sa % SAMPLE == 0)]
        counts = np.bincount(text[words], minlength=vocabulary + 2)
        self.first = self.offset + np.concatenate(([0], np.cumsum(counts)))  # first[c]: rows before those of c
        self.levels = max(1, int(vocabulary).bit_length())
        self.zeros: list[np.ndarray] = []  # of each level: zeros before each position
        self.split: list[int] = []
        now = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            zeros = np.concatenate(([0], np.cumsum(bit == 0, dtype=np.int32)))
            self.zeros.append(zeros)
            self.split.append(int(zeros[-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        lo, hi = np.zeros_like(row), row
        for level, zeros, split in zip(range(self.levels - 1, -1, -1), self.zeros, self.split, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            zl, zh = zeros[lo], zeros[hi]
            lo, hi = np.where(one, split + lo - zl, zl), np.where(one, split + hi - zh, zh)
        return hi - lo

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one word earlier; the word before must not be a separator."""
        at, symbol, lo = row, np.zeros_like(row), np.zeros_like(row)
        for level, zeros, split in zip(range(self.levels - 1, -1, -1), self.zeros, self.split, strict=True):
            z, z1 = zeros[at], zeros[at + 1]
            one = z == z1
            symbol |= one.astype(symbol.dtype) << level
            zl = zeros[lo]
            at, lo = np.where(one, split + at - z, z), np.where(one, split + lo - zl, zl)
        return self.first[symbol] + at - lo

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: (n, longest) words, each right-aligned. Returns the numbers of those that occur and their row ranges."""
        alive = np.arange(len(phrases))
        if not self.size or not len(phrases):
            return alive[:0], alive[:0], alive[:0]
        last = phrases[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for back in range(2, phrases.shape[1] + 1):
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
            more = lengths[alive] >= back
            c = phrases[alive, -back]
            some = np.flatnonzero(more)
            c, l0, h0 = c[some], lo[some], hi[some]
            lo[some], hi[some] = self.first[c] + self.rank(c, l0), self.first[c] + self.rank(c, h0)
        keep = lo < hi
        return alive[keep], lo[keep], hi[keep]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix, and counts the steps."""
        out, todo, at, steps = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.sa_sampled[at]
            out[todo[known]] = self.samples[self.sampled_rank[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            if len(todo):
                at = self.step(at)
                steps += 1
        return out

"""An FM-index over word sequences: suffix order, Burrows-Wheeler transform in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a running count for each 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits among the first i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Rank queries over a sequence of symbols, one bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels, self.zeros = [], []
        self.bits = max(1, int(symbols - 1).bit_length())
        begin = np.zeros(symbols, np.int64)
        of = np.arange(symbols)
        for b in reversed(range(self.bits)):
            bit = (sequence >> b & 1).astype(bool)
            level = BitVector(bit)
            zeros = int(len(bit) - bit.sum())
            up = level.ones(begin)
            begin = np.where(of >> b & 1, zeros + up, begin - up)
            self.levels.append(level)
            self.zeros.append(zeros)
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.begin = begin

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols, for arrays of both."""
        for b, level, zeros in zip(reversed(range(self.bits)), self.levels, self.zeros, strict=True):
            up = level.ones(i)
            i = np.where(c >> b & 1, zeros + up, i - up)
        return i - self.begin[c]


class FMIndex:
    """Finds how often runs of up to `depth` words occur in a text of symbols from 1; 0 parts the text's pieces.

    Suffixes are ordered by at least `depth` symbols, which makes the intervals of patterns up to that length exact."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n, symbols = len(text), int(text.max(initial=0)) + 1
        ranks = {1: text.astype(np.int64)}
        order, k = np.argsort(text), 1
        while k < depth:
            rank = ranks[k]
            then = np.zeros(n, np.int64)
            then[: max(n - k, 0)] = rank[k:] + 1
            key = rank * (n + 2 + symbols) + then
            order = np.argsort(key)
            new = np.concatenate([[0], (key[order][1:] != key[order][:-1])])
            ranks[2 * k] = np.empty(n, np.int64)
            ranks[2 * k][order] = np.cumsum(new)
            k *= 2
        self.size = n
        self.bwt = WaveletMatrix(text[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        # Suffixes that agree in depth - 1 symbols: where their interval begins and ends, for dropping a pattern's last word.
        same, at, left = np.ones(n, bool), order, depth - 1
        for step in sorted(ranks, reverse=True):
            if step <= left:
                r = np.append(ranks[step], -1)[np.minimum(at, n)]
                same &= np.concatenate([[False], r[1:] == r[:-1]])
                at, left = at + step, left - step
        place = np.arange(n)
        self.begin = np.maximum.accumulate(np.where(same, 0, place)) if n else place
        ends = np.append(~same[1:], True) if n else same
        self.end = np.minimum.accumulate(np.where(ends, place + 1, n)[::-1])[::-1]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of c followed by each pattern."""
        base = self.first[c]
        return base + self.bwt.rank(c, lo), base + self.bwt.rank(c, hi)


def repeated_windows(pieces: np.ndarray, lengths: np.ndarray, copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each piece of words (symbols from 1, laid end to end), which windows that start in it occur at least twice.

    All pieces enter the index, those with more copies twice, and all are then streamed through it from their last word to
    their first. The matching statistic kept for each place is the interval of the longest match that starts there, cut at
    `window` words: before a step would pass that length, the last word is dropped by widening the interval."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    again = np.repeat(np.arange(len(lengths)), np.where(copies > 1, 2, 1))
    size = lengths[again] + 1
    at = np.cumsum(size) - size
    text = np.zeros(int(size.sum()), np.int64)
    inner = np.arange(len(text)) - np.repeat(at, size)
    word = inner < np.repeat(lengths[again], size)
    text[word] = pieces[(np.repeat(starts[again], size) + inner)[word]]
    index = FMIndex(text, window)
    by_length = np.argsort(-lengths, kind="stable")
    n, s = lengths[by_length], starts[by_length]
    lo, hi = np.zeros(len(n), np.int64), np.full(len(n), index.size, np.int64)
    found = [np.zeros(max(x - window + 1, 0), bool) for x in lengths]
    marks = np.zeros((len(n), max(int(n.max(initial=0)) - window + 1, 0)), bool)
    for t in range(int(n.max(initial=0))):
        m = int(np.searchsorted(-n, -t, "left"))  # pieces with more than t words come first
        if t >= window:
            hi[:m], lo[:m] = index.end[hi[:m] - 1], index.begin[lo[:m]]
        lo[:m], hi[:m] = index.extend(pieces[s[:m] + n[:m] - 1 - t], lo[:m], hi[:m])
        if t >= window - 1:
            marks[:m, t - window + 1] = hi[:m] - lo[:m] > 1
    for j, i in enumerate(by_length):
        found[i] = marks[j, : len(found[i])][::-1]  # column t holds the window that starts t places before the last one
    return found

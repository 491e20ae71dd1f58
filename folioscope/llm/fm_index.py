"""A compressed full-text index over integer sequences: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np

from folioscope.llm.flat_text import mixed, rolling


def _numbered(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each position, equal keys sharing one."""
    rank = np.zeros(len(order), dtype=np.int64)
    rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
    return rank


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; a suffix that ends sooner comes first.

    With depth, in order of at least that many leading symbols.
    """
    n = len(symbols)
    present = np.zeros(int(symbols.max(initial=0)) + 1, dtype=np.int64)
    present[symbols] = 1
    rank = np.cumsum(present)[symbols]  # from 1: 0 is the end
    bits = int(present.sum()).bit_length()
    step, width = 1, bits
    while 2 * width < 63 and step < n:  # as many leading symbols as one integer holds
        rank = (rank << width) | np.concatenate([rank[step:], np.zeros(step, dtype=np.int64)])
        step, width = 2 * step, 2 * width
    order = np.argsort(rank, kind="stable")
    rank = _numbered(rank[order], order)
    while rank[order[-1]] < n - 1 and step < (depth or n):
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank = _numbered(key[order], order)
        step *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol up to any position, in as many steps as symbols have bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        n = len(symbols)
        blocks = n // 64 + 1
        self.words = np.zeros((self.levels, blocks), dtype=np.uint64)
        self.before = np.zeros((self.levels, blocks), dtype=np.int64)
        self.zeros = np.zeros(self.levels, dtype=np.int64)
        now = symbols.astype(np.int64)
        for level in range(self.levels):
            bits = (now >> (self.levels - 1 - level)) & 1
            packed = np.zeros(blocks * 64, dtype=np.uint8)
            packed[:n] = bits
            self.words[level] = np.packbits(packed, bitorder="little").view("<u8")
            np.cumsum(np.bitwise_count(self.words[level][:-1]), out=self.before[level][1:])
            self.zeros[level] = n - int(bits.sum())
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.origin = self._descend(np.arange(size), np.zeros(size, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[level][block] + np.bitwise_count(self.words[level][block] & mask)
            at = np.where((symbols >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.origin[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, rank): the symbol at each position, and how often it stands before it."""
        symbols = np.zeros(len(at), dtype=np.int64)
        for level in range(self.levels):
            block, place = at >> 6, (at & 63).astype(np.uint64)
            word = self.words[level][block]
            bits = ((word >> place) & np.uint64(1)).astype(np.int64)
            ones = self.before[level][block] + np.bitwise_count(word & ((np.uint64(1) << place) - np.uint64(1)))
            at = np.where(bits, self.zeros[level] + ones, at - ones)
            symbols = symbols << 1 | bits
        return symbols, at - self.origin[symbols]


class FMIndex:
    """Backward search over one sequence of symbols 0 ... size-1; patterns never hold symbol 0, the separator.

    Common prefixes of neighbouring suffixes are kept up to depth symbols, for giving up a match's end; matches
    are told apart up to that length.
    """

    def __init__(self, symbols: np.ndarray, size: int, depth: int = 127):
        self.depth = (1 << max(depth, 1).bit_length()) - 1
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.bwt = WaveletMatrix(symbols[order - 1], size)
        common = np.zeros(self.n + 1, dtype=np.uint8 if self.depth < 256 else np.int32)  # of suffixes i - 1 and i
        common[1 : self.n] = self._common(symbols, order[:-1], order[1:])
        self.least = [common]
        while 2 << len(self.least) - 1 <= self.n:
            last, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _common(self, symbols: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        have = np.zeros(len(first), dtype=np.int64)
        values, step = mixed(symbols.astype(np.uint64) + np.uint64(1)), (self.depth + 1) // 2
        while step:
            a, b = first + have, second + have
            inside = np.flatnonzero((a + step <= self.n) & (b + step <= self.n))
            a, b = a[inside], b[inside]
            have[inside[rolling(values, a, a + step) == rolling(values, b, b + step)]] += step
            step //= 2
        return have.astype(np.uint8 if self.depth < 256 else np.int32)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after putting a symbol in front of what the intervals stand for; -1 occurs nowhere."""
        known = np.maximum(symbols, 0)
        n = len(known)
        both = self.bwt.rank(np.concatenate([known, known]), np.concatenate([low, high]))
        below = self.below[known]
        low, high = both[:n] + below, both[n:] + below
        return low, np.where(symbols < 0, low, high)

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least wider intervals, and how long a match they stand for: the match gives up its end."""
        depth = np.maximum(self.least[0][low], self.least[0][high])
        low, high = low.copy(), high.copy()
        for level in range(len(self.least) - 1, -1, -1):
            least, span = self.least[level], 1 << level
            at = low - span + 1
            low -= span * ((at > 0) & (least[np.maximum(at, 0)] >= depth))
            fits = high + span <= self.n
            high += span * (fits & (least[np.where(fits, high, 0)] >= depth))
        return low, high, depth.astype(np.int64)

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each position of text the length of the longest match that begins there, within its lane.

        Lanes are text[start:end]; all of them are read from their ends in step. Lengths above the index's
        depth may be too small, but not below the depth.
        """
        out = np.zeros(len(text), dtype=np.int64)
        order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[order], ends[order]
        lengths = ends - starts
        low, high, have = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.n), np.zeros(len(starts), dtype=np.int64)
        rising = -lengths
        for back in range(1, int(lengths.max(initial=0)) + 1):
            active = int(np.searchsorted(rising, -back, side="right"))
            at = ends[:active] - back
            symbols = text[at]
            a, b = self.extend(symbols, low[:active], high[:active])
            lost = np.flatnonzero(b <= a)
            have[:active] += 1
            while lost.size:
                over = (have[lost] <= 1) | (symbols[lost] < 0)
                gone, lost = lost[over], lost[~over]
                a[gone], b[gone], have[gone] = 0, self.n, 0
                low[lost], high[lost], depth = self.shorten(low[lost], high[lost])
                have[lost] = depth + 1
                a[lost], b[lost] = self.extend(symbols[lost], low[lost], high[lost])
                lost = lost[b[lost] <= a[lost]]
            low[:active], high[:active] = a, b
            out[at] = have[:active]
        return out

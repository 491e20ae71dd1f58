"""An FM-index over the words of a training shard that finds phrases and where they occur."""

from __future__ import annotations

import numpy as np

from folioscope.llm.fm_index import WaveletMatrix

LANE_WORDS = 128
SAMPLE = 8


def lanes(symbols: np.ndarray, first: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of word ranges that hold every run of least ... most known words of one text.

    symbols: 0 for a word that no phrase has; first: where each text begins, and the end. Runs of known words longer
    than LANE_WORDS (or twice the longest phrase) are laid out in several lanes that share most - 1 words.
    """
    known = symbols > 0
    begins, stops = known.copy(), known.copy()
    begins[1:] &= ~known[:-1]
    stops[:-1] &= ~known[1:]
    inner = first[(first > 0) & (first < len(symbols))]
    begins[inner] |= known[inner]
    stops[inner - 1] |= known[inner - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = b - a >= least
    a, b = a[long], b[long]
    wide = max(LANE_WORDS, 2 * most)
    step = wide - most + 1
    many = np.maximum(-(-(b - a - most + 1) // step), 1)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    starts = np.repeat(a, many) + nth * step
    return starts, np.minimum(starts + wide, np.repeat(b, many))


def lane_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of lanes that each end in a 0, as if the zeros grew from left to right.

    So a comparison ends with its lane. Groups of equal beginnings are refined by doubling; what stands alone
    is left alone.
    """
    n = len(text)
    rank, bits, step = text.astype(np.int64), max(1, int(text.max(initial=0)).bit_length()), 1
    zeros = np.flatnonzero(text == 0)
    left = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n)  # words up to the lane's end
    while 2 * bits < 63:
        rank = (rank << bits) | np.concatenate([rank[step:], np.zeros(min(step, n), dtype=np.int64)])
        step, bits = 2 * step, 2 * bits
    rank[left < step] &= ~((np.int64(1) << np.maximum(step - 1 - left[left < step], 0) * (bits // step)) - 1)  # nothing of the next lane
    order = np.argsort(rank, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (rank[order[1:]] != rank[order[:-1]]) | (left[order[1:]] < step)
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = group
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    open_ = np.flatnonzero(~alone)
    while open_.size:
        at = order[open_]
        key = rank[at] * n + rank[at + step]
        by_key = np.argsort(key, kind="stable")
        at, key = at[by_key], key[by_key]
        order[open_] = at
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0))
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        open_, step = open_[~alone], 2 * step
    return order


class PhraseIndex:
    """Backward search through wavelet-tree ranks, and occurrences by sampled suffix positions."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int):
        sizes = ends - starts
        self.to = np.cumsum(sizes + 1) - sizes - 1  # where each lane begins in the indexed text
        self.shift = starts - self.to
        text = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)
        inner = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
        text[inner] = symbols[inner + np.repeat(self.shift, sizes)]
        order = lane_suffixes(text)
        before = text[order - 1]
        self.n = len(text)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.bwt = WaveletMatrix(before, size)
        kept = (order % SAMPLE == 0) | (before == 0)  # a lane's first word is always kept: no walk leaves its lane
        self.kept, self.positions = WaveletMatrix(kept.astype(np.int64), 2), order[kept].astype(np.int32)

    def intervals(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases, rows of symbols padded behind their lengths; empty where a phrase is not here."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n)
        live = np.flatnonzero(lengths > 0)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            symbols = phrases[live, lengths[live] - back]
            both = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.below[symbols] + both[: len(live)], self.below[symbols] + both[len(live) :]
        return low, np.where(lengths > 0, high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The word at which each suffix begins: walks to the word before until a row's position is kept."""
        out, live, now = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), rows
        steps = 0
        while live.size:
            kept, place = self.kept.access(now)
            done = kept == 1
            out[live[done]] = self.positions[place[done]] + steps
            live, now = live[~done], now[~done]
            symbols, rank = self.bwt.access(now)
            now, steps = self.below[symbols] + rank, steps + 1
        return out + self.shift[np.searchsorted(self.to, out, side="right") - 1]

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, word): which phrase begins at which word; a word that two lanes share may come twice."""
        low, high = self.intervals(phrases, lengths)
        times = np.maximum(high - low, 0)
        rows = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(np.arange(len(phrases)), times), self.locate(rows)

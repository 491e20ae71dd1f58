"""Arrow text columns as flat byte arrays, and word hashes over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes between words of lower-cased letters and digits; all bytes of characters beyond ASCII are in words.
SIGNS = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in range(256)])
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def handing_back(step: Callable) -> Callable:
    """step over a task's batches; at its end Arrow's unused memory goes back to the system, as workers outlive their tasks."""

    @wraps(step)
    def run(*args, **kwargs):
        yield from step(*args, **kwargs)
        pa.default_memory_pool().release_unused()

    return run


def slices(batch: pa.RecordBatch, column: str, most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about most bytes of text each; a longer text stands alone."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 bytes of all texts one after the other; nulls are empty."""
    texts = texts.fill_null("").cast(pa.string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.ones(max(n, 1 << 16), dtype=np.uint64)
        held[1:] = np.uint64(base)
        np.multiply.accumulate(held, out=held)
        if len(held) <= 1 << 21:
            _powers[base] = held
    return held[:n]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each pair: a polynomial modulo 2**64, scrambled."""
    n = len(values) + 1
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum(values * powers(BASE, n - 1), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts])


def word_bounds(body: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and the index of each text's first word (and the end)."""
    word = ~gaps[body]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(body))]
    begins[inner] |= word[inner]
    stops[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(body: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): a 64-bit hash of each word, with word_bounds."""
    starts, ends, first = word_bounds(body, offsets, gaps)
    return rolling(body.astype(np.uint64) + np.uint64(1), starts, ends), starts, ends, first

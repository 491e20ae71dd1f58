"""Word shingle sets of whole texts, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from folioscope.llm.flat_text import flat, mixed, rolling, slices, word_hashes

#: Bytes in lower case where they are A-Z; UTF-8 letters beyond ASCII stay.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash): the distinct shingles of each text, ordered by text and hash.

    A-Z count as lower case. A text with fewer words has one shingle of all of them; without words, none.
    """
    body, offsets = flat(texts)
    hashes, _, _, first = word_hashes(LOWER[body], offsets)
    have = np.diff(first)
    each = np.where(have, np.maximum(have - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(have)), each)
    starts = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + first[owner]
    found = rolling(hashes, starts, np.minimum(starts + words, first[owner + 1]))
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], found[fresh]


def shingle_sets(batches, words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, owner, hashes, sizes) for bounded parts of Arrow batches with a column text."""
    for batch in batches:
        for part in slices(batch, "text"):
            owner, hashes = shingle_hashes(part.column("text"), words)
            yield part, owner, hashes, np.bincount(owner, minlength=part.num_rows)


def fingerprints(owner: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each text's set: equal sets have equal ones, whatever the order."""
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(rows, dtype=np.uint64)
        np.add.at(total, owner, mixed(hashes ^ np.uint64(salt)))
        sums.append(total.astype(np.int64))
    return sums[0], sums[1]

"""Words and word shingles of many texts at once, as 64-bit hashes of their bytes."""

from __future__ import annotations

import numpy as np

from .common import inner_ranges, mix64

#: The bytes between words (space and 09-0D).
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.Generator(np.random.PCG64(20))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text number) of every word; words end where their text does."""
    inside = ~SEPARATORS[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] |= inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= inside[ends]
    # A text's first byte also ends the word before it, which then has its last byte at that text's end.
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops - starts, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    within = inner_ranges(lengths)
    values = _BYTE[data[np.repeat(starts, lengths) + within]] * _powers(int(lengths.max()))[within]
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(np.uint64) * _STEPS[0])


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of size words of the lower-cased texts, repeats included, in order.

    A text of fewer words is one shingle; a text without words has none.
    """
    data = LOWER[data]
    starts, lengths, text = split_words(data, offsets)
    hashes = word_hashes(data, starts, lengths)
    counts = np.bincount(text, minlength=len(offsets) - 1).astype(np.int64)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), many)
    first = (np.cumsum(counts) - counts)[owner] + inner_ranges(many)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    out = np.zeros(len(owner), np.uint64)
    have = np.minimum(counts, size)[owner]
    for k in range(size):
        out += np.where(k < have, padded[first + k] * _STEPS[1 + k], np.uint64(0))
    return mix64(out + have.astype(np.uint64)), owner

"""Sets of word shingles of whole texts, as 64-bit hashes, in numpy.

Words are runs of bytes that are no white space (space, tab, line ends); A-Z count as a-z. A set has the hashes of
all runs of ``size`` words; a text of fewer words has its whole sequence as its one shingle; no words, no shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

WINDOW = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE, _BASE_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
LOWER += np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.cache
def _window_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers and their inverses for the usual pieces: 32 MB, so made by the first text hashed in a process and never by the driver."""
    return _powers(_BASE, 2 * WINDOW), _powers(_BASE_INVERSE, 2 * WINDOW)


def _hash_window(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a piece of text that ends at a word's end."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACES[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    powers, inverses = _window_powers() if len(data) <= 2 * WINDOW else (_powers(_BASE, len(data)), _powers(_BASE_INVERSE, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LOWER[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * _ODD), starts, ends


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word in order; long texts go window by window."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= WINDOW:
        return _hash_window(data)
    parts, a = [], 0
    while a < len(data):
        b = min(a + WINDOW, len(data))
        while b < len(data) and not SPACES[data[b]]:  # to the end of the word
            step = np.flatnonzero(SPACES[data[b : b + WINDOW]])
            b = b + int(step[0]) if len(step) else min(b + WINDOW, len(data))
        hashes, starts, ends = _hash_window(data[a:b])
        parts.append((hashes, starts + a, ends + a))
        a = b
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = words_of(text)[0]
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    total = np.full(n, np.uint64(min(len(words), size) * int(_ODD) % (1 << 64)))
    for k in range(min(size, len(words))):
        total += words[k : k + n] * _factor(k)
    return np.unique(mix(total))


def _factor(k: int) -> np.uint64:
    return np.uint64((0xA0761D6478BD642F * (2 * k + 1) + 0xE7037ED1A0B428DA * k * k * 2) % (1 << 64) | 1)


def set_slices(texts: Iterator[bytes], shingles: int = 100_000, size: int = 5) -> Iterator[list[np.ndarray]]:
    """Sets of consecutive texts in lists of so many shingles or of one text."""
    held, n = [], 0
    for text in texts:
        held.append(shingle_set(text, size))
        n += len(held[-1])
        if n >= shingles:
            yield held
            held, n = [], 0
    if held:
        yield held

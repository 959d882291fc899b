"""Numpy kernels for tasks: 64-bit hashes of the words and word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither letter nor digit, for words without punctuation.
_IS_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some `chars` characters each; one longer text makes a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hashed_words(texts: list[str], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) in order, and the offsets at which each text's words start (one more than texts).

    Words end at white space, with `bare` at any ASCII sign but letters and digits.
    """
    blobs = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    data = _LOWER[data]
    space = (_IS_BREAK if bare else _IS_SPACE)[data]
    inner = ~space
    first = inner.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    bounds = np.cumsum([0] + [len(b) + 1 for b in blobs])
    offsets = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets
    spans = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    power = np.cumprod(np.full(int(spans.max()), _BASE), dtype=np.uint64)
    terms = np.where(inner[starts[0] :], _BYTE[data[starts[0] :]], np.uint64(0)) * power[at]
    return mixed(np.add.reduceat(terms, starts - starts[0])), offsets


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's `width`-word shingles; a shorter text's whole sequence is its one shingle."""
    words, offsets = hashed_words(texts)
    n = len(words)
    if n >= width:
        rolled = np.zeros(n - width + 1, dtype=np.uint64)
        for j in range(width):
            rolled += words[j : n - width + 1 + j] * _STEP[j]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out

"""Words of whole texts as arrays: one pass over the bytes of many texts, no Python object per word.

A word is a run of bytes other than space and 0x09-0x0D.  Its 64-bit hash is a polynomial in its bytes (random odd
base, random value per byte), taken from prefix sums, then scrambled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C1B | 3
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWERED = VALUES.copy()
LOWERED[65:91] = VALUES[97:123]
STEP = 1 << 19
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and ``BASE ** -i`` for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    found = _powers["up"][:n], _powers["down"][:n]
    if len(_powers["up"]) > 4 * STEP:  # a very long text's are not kept
        _powers.clear()
    return found


def scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the end) for texts ``data[offsets[i]:offsets[i+1]]``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACES[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:]))
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((LOWERED if lower else VALUES)[data] * up, out=sums[1:])
    hashes = scramble((sums[ends + 1] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def slices(texts: list[bytes], limit: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) for runs of texts of about ``limit`` bytes; a longer text comes alone and whole."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i, *joined(texts[first:i])
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts), *joined(texts[first:])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of ``k`` words, in order; runs may cross texts, which the caller leaves out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += words[j : j + n] * np.uint64(ODD[j % len(ODD)] + 2 * (j // len(ODD)))
    return scramble(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is much faster here than hashing."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of one text; fewer words: the whole sequence as one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return distinct(ngram_hashes(words, min(k, len(words))) + np.uint64(min(k, len(words))))

"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: An odd base and its inverse modulo 2**64: the hash of bytes b0 b1 .. is the sum of b_i * BASE**i, then mixed.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.ones(max(n, 1 << 16), dtype=np.uint64)
        known[1:] = base
        known = _powers[base] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_table(lower: bool) -> np.ndarray:
    """What each byte counts as: 0 for white space, else itself, A-Z as a-z if ``lower``."""
    return np.array([0 if c in SPACES else c + 32 if lower and 65 <= c <= 90 else c if c else 256 for c in range(256)], dtype=np.uint64)


FOLDED = {flag: fold_table(flag) for flag in (False, True)}


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and where each text's words begin (one entry more)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    folded = FOLDED[lower][data]
    inside = folded != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.cumsum(folded * powers(BASE, len(folded)))
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends - 1] - before) * powers(INVERSE, len(folded))[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(starts, text_ends)])


FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``size``-word shingles, A-Z lower-cased, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    hashes, bounds = word_hashes(texts, lower=True)
    m = len(hashes) - size + 1
    whole = np.zeros(max(0, m), dtype=np.uint64)
    for j in range(size):
        whole += hashes[j : j + max(0, m)] * FACTORS[j]
    whole = mix(whole)
    parts = []
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= size:
            parts.append(np.unique(whole[start : end - size + 1]))
        elif end > start:
            few = (hashes[start:end] * FACTORS[: end - start]).sum(dtype=np.uint64, keepdims=True)
            parts.append(mix(few + FACTORS[32 + end - start : 33 + end - start]))
        else:
            parts.append(np.zeros(0, dtype=np.uint64))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def rolling(hashes: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """A hash of each run of ``size`` consecutive numbers, in time that doesn't depend on ``size``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers(base, len(hashes)))])
    return mix((sums[size:] - sums[:-size]) * powers(pow(base, -1, 1 << 64), n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - span : width - span + n]) if n > 0 else values[:0]

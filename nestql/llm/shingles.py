"""Sets of word shingles as 64-bit hashes, and their MinHash signatures, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import MASK64, WordHashes, mix

_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; fewer words than `width` are one shingle, no words none."""
    words = WordHashes(texts)
    h, first = words.hash, words.first
    weights = np.resize(_WEIGHTS, width) * (np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    if len(h) >= width:
        n = len(h) - width + 1
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += h[j : j + n] * weights[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = (h[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    a = int(mix(shingles).sum(dtype=np.uint64))
    b = int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def universal_hashes(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of k multiply-shift universal hash functions."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, MASK64, k, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return a, rng.integers(0, MASK64, k, dtype=np.uint64, endpoint=True)


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of every hash function over every non-empty set, as 32-bit values, a row per set."""
    out = np.empty((len(sets), len(a)), np.uint32)
    if not sets:
        return out
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    step = 1 << 15
    groups, begin = [], 0
    sizes = [len(s) for s in sets]
    total = 0
    for i, n in enumerate(sizes):
        if total and total + n > step:
            groups.append((begin, i))
            begin, total = i, 0
        total += n
    groups.append((begin, len(sets)))
    for i, j in groups:
        lo, hi = starts[i], starts[j] if j < len(sets) else len(flat)
        x, at = flat[lo:hi], starts[i:j] - lo
        for k in range(len(a)):
            out[i:j, k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), at)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each row; equal in two rows when all the band's minima are."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(31) + parts[:, :, j] + np.uint64(1))
    return mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

"""Word shingles of whole texts, MinHash signatures, band keys and odd sketches."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS = 512
REMEMBERED = 150_000
BLOCK = 4096

_rng = np.random.default_rng(20240601)
_MULTIPLY = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_PLACE = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)], dtype=np.uint64)
_SAMPLE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_ROW = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_known: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; fewer words make one shingle, none an empty set.

    Lower-casing and splitting are those of bytes: A-Z, and space and 9-13.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    if len(_known) > REMEMBERED:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - WORDS + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(mixed(total))


def set_digest(shingles: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of SAMPLES hash functions over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), BLOCK):
        np.minimum(low, (x[None, at : at + BLOCK] * _MULTIPLY + _ADD).min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ROWS minima."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((mixed(rows) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (sample, minimum) pairs as BITS / 64 integers.

    The exclusive or of two sketches is the sketch of the samples that differ.
    """
    place = (mixed(sig.astype(np.uint64) ^ _SAMPLE) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def most_odd_bits(similarity: float, sigmas: float = 5.0) -> int:
    """Bits that may differ between sketches of sets at least that similar.

    Samples that differ are binomial around SAMPLES * (1 - similarity); each puts
    two entries into the bitmap, and parities saturate by 1 - (1 - 2 / BITS) ** entries.
    """
    share = 1 - similarity
    entries = 2 * (SAMPLES * share + sigmas * np.sqrt(SAMPLES * share * (1 - share)))
    bits = BITS / 2 * (1 - (1 - 2 / BITS) ** entries)
    return int(np.ceil(bits + sigmas * np.sqrt(bits * (1 - bits / BITS) / 2)))

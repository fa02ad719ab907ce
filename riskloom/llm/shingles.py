"""Word shingles of whole texts as 64-bit hashes, and universal-hash minima over them; numpy over whole batches."""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, all other bytes as they are
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_seed = np.random.default_rng(20240607)
BYTE = _seed.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE = _seed.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word (bytes between white space), in order."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * _powers(STEP, len(raw)), out=sums[1:])
    return mix((sums[end] - sums[first]) * _powers(BACK, len(raw))[first] + (end - first).astype(np.uint64) * PLACE[0])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingles of ``width`` words; a text with fewer words is one shingle, one without words has none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not len(words):
        return words
    if len(words) < width:
        return mix(np.sum(words * PLACE[1:len(words) + 1], keepdims=True) + PLACE[-len(words)])
    n = len(words) - width + 1
    total = words[:n] * PLACE[1]
    for k in range(1, width):
        total = total + words[k:k + n] * PLACE[k + 1]
    return np.unique(mix(total))


class Minima:
    """``bands * rows`` minima of ``(a * x + b) mod 2**64``; band keys for candidates and one byte of each minimum for checks."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.a = draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, n, np.uint64)
        self.salt = draw.integers(1, 1 << 63, (bands, rows + 1), np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1024):
            part = self.a[:, None] * shingles[None, at:at + 1024] + self.b[:, None]
            np.minimum(low, part.min(1), out=low)
        return low

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One key for each band, different bands apart."""
        grid = minima.reshape(self.bands, self.rows) >> np.uint64(16)
        return mix((grid * self.salt[:, 1:]).sum(1) + self.salt[:, 0]).view(np.int64)

    def bytes(self, minima: np.ndarray) -> bytes:
        return (minima >> np.uint64(40)).astype(np.uint8).tobytes()


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shared(a: bytes, b: bytes) -> int:
    """Size of the intersection of two packed sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())

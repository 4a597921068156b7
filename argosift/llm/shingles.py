"""Shingle hashing and minhash signatures over plain numpy arrays (no Spark in here)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z alone; other letters keep their case."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def words_of(text: str | None) -> list[str]:
    """Words of a text: runs without blanks, A-Z lower-cased; none for null."""
    return WORD.findall(ascii_lower(text)) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


_RNG = np.random.default_rng(20)
#: A random value for each byte, the same for a letter A-Z and its lower case, and whether the byte is a blank.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words in order: polynomials over the UTF-8 bytes, from one running sum over the text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_BLANK[raw]
    if not inside.any():
        return np.empty(0, np.uint64)
    turn = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = turn[::2], turn[1::2]
    power, inverse = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts])


_WEIGHTS = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles (k up to 64); a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = hashes[: n - k + 1] * _WEIGHTS[0] + np.uint64(k)
        for i in range(1, k):
            h += hashes[i : n - k + 1 + i] * _WEIGHTS[i]
        h = np.sort(mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


class MinHasher:
    """`bands` x `rows` minima of multiply-add-shift hashes (a universal family over 32-bit keys)."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, m = bands, rows, bands * rows
        self.a = rng.integers(1, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, m, dtype=np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        """One 32-bit minimum for each function; s: the distinct shingle hashes, not empty."""
        out = np.full(len(self.a), np.uint64(2**64 - 1))
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 512):  # a block that stays in cache
                x = s[at : at + 512] >> np.uint64(32)
                np.minimum(out, (self.a[:, None] * x[None, :] + self.b[:, None]).min(axis=1), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """A signed 64-bit key for each band, which tells bands apart too."""
        with np.errstate(over="ignore"):
            h = np.arange(self.bands, dtype=np.uint64) * _STEP
            for row in minima.reshape(self.bands, self.rows).T.astype(np.uint64):
                h = mix(h + _STEP) ^ row
            return mix(h).view(np.int64)


def set_digest(s: np.ndarray) -> bytes:
    """16 bytes that stand for a whole shingle set."""
    return xxhash.xxh3_128_digest(np.ascontiguousarray(s).tobytes())

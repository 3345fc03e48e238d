"""Vectorised hashes of bytes, words and word sequences, alike on every machine."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20_240_601))
#: A random odd number for each byte value, and the base of the polynomial hashes.
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)

#: A-Z folded; the six white-space bytes of words stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 .. n - 1, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, BASE)]), dtype=np.uint64)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of the text, A-Z folded; words are runs of anything but the six white-space bytes."""
    b = np.frombuffer(text.encode().translate(FOLD), dtype=np.uint8)
    at = np.flatnonzero(~IS_SPACE[b])
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
    size = np.diff(np.concatenate([first, [len(at)]]))
    place = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(BYTE[b[at]] * powers(int(size.max()))[place], first)
        return mix(sums + size.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of `width` neighbouring words; of fewer words, but not none, the whole sequence."""
    n = min(width, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1] + U(n)
        for k in range(1, n):
            out = mix(out * U(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return np.unique(out)


def sequence_digest(words: np.ndarray) -> tuple[int, int]:
    """128 bits of the words in their order, as two signed 64-bit numbers."""
    n = np.arange(1, len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        a = mix(words + n * U(0xA24BAED4963EE407)).sum(dtype=np.uint64)
        b = mix((words ^ U(0x5851F42D4C957F2D)) + n * U(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))

"""Hashes of stretches of sequences, vectorised: polynomials modulo 2^64 whose prefix sums give any stretch's hash."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_RADIX = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes; arithmetic wraps."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def rolling(items: np.ndarray):
    """A function of (first places, end places) that gives the hashes of those stretches of the items (numbers above 0)."""
    n = len(items) + 1
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_RADIX, pow(_RADIX, -1, 1 << 64)):
            p = np.full(max(n, 4096), base, U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    up, down = _powers
    total = np.zeros(n, U)
    np.cumsum(mix(items) * up[: n - 1], out=total[1:])
    return lambda first, end: mix((total[end] - total[first]) * down[first])


_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_KEPT = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_ENDED = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def md5_heads(raw: bytes, first: np.ndarray, end: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """The first 32 bits of the md5 of each stretch of bytes, as big-endian numbers. Stretches of up to 55 bytes are one block of
    md5 and are worked on together."""
    out = np.empty(len(first), np.uint64)
    long = end - first > 55
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.md5(raw[first[i] : end[i]]).digest()[:4], "big")
    padded = np.zeros(len(raw) + 60, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    four = sum(padded[k : len(raw) + 56 + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    short = np.flatnonzero(~long)
    for at in range(0, len(short), block):
        own = short[at : at + block]
        begin, size = first[own], end[own] - first[own]
        message: list = [None] * 16
        for j in range(int(size.max()) // 4 + 1):
            left = np.clip(size - 4 * j, -1, 4) + 1
            message[j] = four[begin + 4 * j] & _KEPT[left] | _ENDED[left]
        message[14] = (size * 8).astype(np.uint32)
        out[own] = _md5_word(message, len(own)).byteswap()
    return out


def _md5_word(message: list, n: int) -> np.ndarray:
    """The first word of the md5 of n messages of one block, given as 16 words each; None stands for zeros."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x) for x in start)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += _SINES[i]
        if message[_PLACES[i]] is not None:
            f += message[_PLACES[i]]
        high = f >> (np.uint32(32) - _TURNS[i])
        f <<= _TURNS[i]
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return a + start[0]

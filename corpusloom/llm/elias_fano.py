"""Elias-Fano sequences in memory-mapped files, with vectorised successor search."""

from __future__ import annotations

import json

import numpy as np
from pyarrow import fs

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _NTH[b, r]: place of the r-th set bit of byte b.
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(k for k in range(8) if _b >> k & 1):
        _NTH[_b, _r] = _p
U = np.uint64


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers of `width` bits (at most 57), one after the other, in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, U)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U)
        v = values.astype(U)
        np.bitwise_or.at(out, word, v << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.int64)
    bit = at * width
    octets = words.view(np.uint8)
    every = np.ndarray(len(octets) - 7, "<u8", octets, strides=(1,))  # the eight bytes from each byte on
    return ((every[bit >> 3] >> (bit & 7).astype(U)) & U((1 << width) - 1)).view(np.int64)


class EliasFano:
    """A rising sequence from `first` to `last`: low bits packed, high bits in unary with counts for each word.

    For searches a directory tells how many keys lie up to each bucket of equal high bits: `inside` its block of BLOCK buckets
    (2 bytes as a rule), and `before` the block. It lies in the file, too, so a search reads a few places of it."""

    BLOCK = 10

    def __init__(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, before: np.ndarray | None = None, inside: np.ndarray | None = None):
        self.n, self.width, self.first, self.last = shape.tolist()
        self.low, self.high, self.zeros, self.before, self.inside = low, high, zeros, before, inside

    @staticmethod
    def build(keys: np.ndarray, searched: bool = True) -> dict[str, np.ndarray]:
        """Of at least one key; keys are non-negative."""
        n, first, last = len(keys), int(keys[0]), int(keys[-1])
        universe, keys = last - first + 1, keys - first
        width = min(57, max(0, int(universe // max(n, 1)).bit_length() - 1))
        buckets = (int(universe) >> width) + 1
        high = np.zeros((n + buckets) // 64 + 1, U)
        at = (keys >> width) + np.arange(n)
        np.bitwise_or.at(high, at >> 6, U(1) << (at & 63).astype(U))
        ones = _ONES[high.view(np.uint8).reshape(-1, 8)].sum(1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)]).astype(np.int64)
        out = {"shape": np.array([n, width, first, last], np.int64), "low": pack(keys & ((1 << width) - 1), width), "high": high, "zeros": zeros}
        if searched:
            upto = np.cumsum(np.bincount(keys >> width, minlength=buckets))
            before = np.concatenate([[0], upto[(1 << EliasFano.BLOCK) - 1 :: 1 << EliasFano.BLOCK]])
            inside = upto - before[np.arange(buckets) >> EliasFano.BLOCK]
            out |= {"before": before, "inside": inside.astype(np.uint16 if inside.max() < 1 << 16 else np.uint32)}
        return out

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        return cls(*(parts.get(k) for k in ("shape", "low", "high", "zeros", "before", "inside")))

    def _upto(self, bucket: np.ndarray) -> np.ndarray:
        """How many keys lie in these buckets and all before."""
        return self.before[bucket >> self.BLOCK] + self.inside[bucket]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The keys at these places."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, places, side="right") - 1
        left = (places - ones[word]).astype(np.int64)
        octets = self.high[word].view(np.uint8).reshape(-1, 8)
        counts = np.cumsum(_ONES[octets], 1, dtype=np.uint8)
        which = (counts <= left[:, None].astype(np.uint8)).sum(1)
        rows = np.arange(len(places))
        left -= np.where(which > 0, counts[rows, np.maximum(which - 1, 0)], 0)
        high = word * 64 + which * 8 + _NTH[octets[rows, which], left] - places
        return (high << self.width) + unpack(self.low, self.width, places) + self.first

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it isn't there: binary search among those that share its high bits."""
        out = np.full(len(keys), -1, np.int64)
        inside = np.flatnonzero((keys >= self.first) & (keys <= self.last))
        if not len(inside):
            return out
        keys = keys[inside] - self.first
        bucket = (keys >> self.width).astype(np.int64)
        end = self._upto(bucket)
        lo = np.where(bucket > 0, self._upto(np.maximum(bucket - 1, 0)), 0)
        want, hi = keys & ((1 << self.width) - 1), end.copy()
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) >> 1
            less = unpack(self.low, self.width, mid) < want[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
        ok = lo < end
        ok[ok] = unpack(self.low, self.width, lo[ok]) == want[ok]
        out[inside[ok]] = lo[ok]
        return out


def place(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it); paths without a scheme are local ones (those of common.fresh_dir have one)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a JSON table of contents, then the arrays, each from a multiple of 64 bytes on."""
    told, at = {}, 0
    for name, a in arrays.items():
        told[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(told).encode()
    start = -(-(8 + len(head)) // 64) * 64
    where, name = place(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name) as f:
        f.write((len(head).to_bytes(8, "little") + head).ljust(start, b"\0"))
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays: mapped into memory where the file system is local, else read."""
    where, name = place(path)
    if isinstance(where, fs.LocalFileSystem):
        raw = np.asarray(np.memmap(name, np.uint8, "r"))  # plain views: a memmap object is slow to index
    else:
        with where.open_input_file(name) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    start = -(-(8 + n) // 64) * 64
    out = {}
    for key, (kind, length, at) in json.loads(raw[8 : 8 + n].tobytes()).items():
        kind = np.dtype(kind)
        out[key] = raw[start + at : start + at + length * kind.itemsize].view(kind)
    return out

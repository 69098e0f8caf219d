"""Vectorised words and word hashes of whole text columns, for use inside tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D within one document. Work
goes by slices of about ``SLICE`` bytes, so memory depends on the slice and on the longest
document, not on the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

#: The call of the C library that hands free memory back to the system, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The Mersenne prime of the polynomial hashes, and of each of the two families the seed of
#: its word hashes and the base of its polynomials (fixed values, drawn once).
PRIME = (1 << 61) - 1
_FAMILIES = ((1677995282, 1188885285591443942), (3577020172, 1882348692496916813))
_BLOCK = 1 << 16
_P, _30, _31, _32 = (np.uint64(x) for x in (PRIME, (1 << 30) - 1, (1 << 31) - 1, (1 << 32) - 1))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Products modulo the prime; the second factors are given as ``high * 2**31 + low``."""
    h, l = x >> np.uint64(31), x & _31
    middle = h * low + l * high
    return _reduced(np.uint64(2) * h * high + (middle >> np.uint64(30)) + ((middle & _30) << np.uint64(31)) + l * low)


@cache
def _powers(family: int, n: int) -> tuple[np.ndarray, ...]:
    """The first n powers of a family's base and of its inverse, as high and low parts."""
    out = []
    base = _FAMILIES[family][1]
    for step in (base, pow(base, -1, PRIME)):
        x = np.ones(1, np.uint64)
        while len(x) < n:
            f = pow(step, len(x), PRIME)
            x = np.concatenate([x, _times(x, np.uint64(f >> 31), np.uint64(f & ((1 << 31) - 1)))])
        out += [x[:n] >> np.uint64(31), x[:n] & _31]
    return tuple(out)


#: The primes of XXH64 (fixed values of its published specification).
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _lane(word: np.ndarray) -> np.ndarray:
    return _rotl(word * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each byte range; ranges of 32 bytes and more go one by one."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    long = np.flatnonzero(size >= 32)
    view = memoryview(np.ascontiguousarray(data))
    digest = xxhash.xxh64_intdigest
    out[long] = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)))
    for lanes in range(4):
        for four in (0, 1):
            at = np.flatnonzero((size >> 3 == lanes) & ((size >> 2 & 1) == four))
            if not len(at):
                continue
            p, n = starts[at], size[at]
            h = np.uint64(seed) + _P5 + n.astype(np.uint64)
            for _ in range(lanes):
                h = _rotl(h ^ _lane(eight[p]), 27) * _P1 + _P4
                p = p + 8
            if four:
                h = _rotl(h ^ (eight[p] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
                p = p + 4
            for k in range(3):
                more = np.flatnonzero((n & 3) > k)
                h[more] = _rotl(h[more] ^ data[p[more] + k].astype(np.uint64) * _P5, 11) * _P1
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            out[at] = h ^ (h >> np.uint64(32))
    return out


class Texts:
    """Consecutive documents as one byte array; ``offsets`` has one more entry than documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of words up to each document."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        space = _SPACE[self.data]
        edge = np.empty(len(space), bool)
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(space))]
        edge[0] = True
        edge[1:] = space[:-1]
        edge[inner] = True
        starts = np.flatnonzero(edge & ~space)
        edge[:-1] = space[1:]
        edge[-1] = True
        edge[inner - 1] = True
        ends = np.flatnonzero(edge & ~space) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
        """A 64-bit hash (XXH64 with the family's seed) of each byte range."""
        return xxh64(self.data, starts, ends, _FAMILIES[family][0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Hand back the memory that earlier work freed, so that a worker holds what it uses."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows ``lo, hi`` with about ``size`` bytes each, and their texts.

    Freed memory goes back before the first and after the last run, so a worker that waits
    for its next task holds little, and one that works holds one batch.
    """
    release()
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    release()


def windows(hashes: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` consecutive word hashes (empty if there are fewer).

    The word hashes are the coefficients of a polynomial whose value at the family's base,
    modulo the prime, is the hash: two different runs of n words agree for at most n of the
    2**61 bases, and with both families for one pair of bases in 2**110. The cost doesn't
    depend on the length, and memory goes by blocks.
    """
    out = np.zeros(max(0, len(hashes) - length + 1), np.uint64)
    block = max(_BLOCK, length)
    up_high, up_low, down_high, down_low = _powers(family, block + length)
    for lo in range(0, len(out), block):
        part = hashes[lo : lo + block + length - 1]
        terms = _times(_reduced(part), up_high[: len(part)], up_low[: len(part)])
        low, high = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (terms & _32, terms >> np.uint64(32)))
        n = len(part) - length + 1
        high = high[length:] - high[:n]
        value = (high >> np.uint64(29)) + ((high & (_P >> np.uint64(32))) << np.uint64(32)) + (low[length:] - low[:n])
        out[lo : lo + n] = mixed(_times(_reduced(value), down_high[:n], down_low[:n]))
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + counts[i] - 1`` of all i, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def joined(texts: Texts, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space within each document.

    Word ``i`` is ``starts[i]:ends[i]``, in order; ``upto`` counts words up to each document.
    Gives the new bytes, where each word starts in them, and each document's offsets.
    """
    size = ends - starts
    apart = np.ones(len(size), np.int64)
    counts = np.diff(upto)
    apart[upto[1:][counts > 0] - 1] = 0
    new = np.cumsum(size + apart) - size - apart
    total = int(new[-1] + size[-1]) if len(size) else 0
    out = np.full(total, 0x20, np.uint8)
    if total:
        out[_inside(new, new + size, total)] = texts.data[_inside(starts, ends, len(texts.data))]
    edges = np.append(new, total)[upto]
    last = np.zeros(len(upto), np.int64)
    last[1:][counts > 0] = (new + size)[upto[1:][counts > 0] - 1]
    return out, new, np.stack([edges[:-1], np.maximum(last[1:], edges[:-1])])


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges (which don't overlap)."""
    step = np.zeros(n + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def located(first: np.ndarray, second: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where each pair ``one, two`` stands among pairs sorted by ``first``; -1 where it doesn't."""
    out = np.full(len(one), -1, np.int64)
    left = np.arange(len(one)) if len(first) else np.zeros(0, np.int64)
    at = np.searchsorted(first, one) if len(first) else left
    while len(left):
        here = at < len(first)
        left, at = left[here], at[here]
        same = first[at] == one[left]
        hit = same & (second[at] == two[left])
        out[left[hit]] = at[hit]
        go = same & ~hit
        left, at = left[go], at[go] + 1
    return out

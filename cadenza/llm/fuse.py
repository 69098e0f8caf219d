"""A static binary-fuse filter over 64-bit keys (three positions, 16-bit fingerprints).

Membership has no false negative; a foreign key passes with a chance of 2**-16.
"""

from __future__ import annotations

import struct

import numpy as np

from .words import mixed

_HEAD = struct.Struct("<QIII")


def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three array positions in consecutive segments and the fingerprint of each key."""
    h = mixed(keys + np.uint64(seed))
    base = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    at = np.empty((3, len(keys)), np.int64)
    at[0] = base
    at[1] = (base + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
    at[2] = (base + np.uint64(2 * segment)) ^ (h & low)
    return at, ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of keys as bytes; repeated keys count once."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, -(-int(n * factor) // segment) - 2)
    size = (count + 2) * segment
    for seed in range(1, 1000):
        salt = int(mixed(np.array([seed], np.uint64))[0])
        at, prints = _places(keys, salt, segment, count)
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.uint64)
        ids = np.arange(n, dtype=np.uint64)
        for row in at:
            np.bitwise_xor.at(owner, row, ids)
        left, rounds = n, []
        single = np.flatnonzero(degree == 1)
        while len(single):
            found, first = np.unique(owner[single].astype(np.int64), return_index=True)
            rounds.append((found, single[first]))
            left -= len(found)
            touched = at[:, found]
            for row in touched:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(owner, row, found.astype(np.uint64))
            touched = np.unique(touched)
            single = touched[degree[touched] == 1]
        if left == 0:
            table = np.zeros(size, np.uint16)
            for found, slot in reversed(rounds):
                cells = at[:, found]
                table[slot] = 0
                table[slot] = prints[found] ^ table[cells[0]] ^ table[cells[1]] ^ table[cells[2]]
            return _HEAD.pack(salt, segment, count, n) + table.tobytes()
        if seed % 10 == 0:  # an unlucky small set: give it more room
            count += max(1, count // 8)
            size = (count + 2) * segment
    raise ValueError(f"no filter found for {n} keys")


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the set of the filter."""
    salt, segment, count, n = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint16, offset=_HEAD.size)
    at, prints = _places(keys.astype(np.uint64), salt, segment, count)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == prints

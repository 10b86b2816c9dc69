"""Static binary-fuse filters built and probed with numpy.

A filter maps each 64-bit key to three slots in adjacent segments; the slots'
fingerprints xor to the key's own.  A key that was put in is always found; any
other is found with probability 2**-16.
"""

from __future__ import annotations

import struct

import numpy as np

_HEADER = struct.Struct("<QIII")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S32 = np.uint64(33), np.uint64(32)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots a key, one in each of three adjacent segments."""
    first = ((h >> _S32) * np.uint64(segments) >> _S32).astype(np.int64)
    mask = np.uint64(segment - 1)
    out = np.empty((3, len(h)), dtype=np.int64)
    for k, shift in enumerate((0, 18, 36)):
        low = ((h >> np.uint64(shift)) & mask).astype(np.int64)
        out[k] = (first + k) * segment + low
    return out


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _S32)) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """The filter of distinct uint64 ``keys`` (repeats are dropped)."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    if n == 0:
        return b""
    segment = 1 << max(3, min(17, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += 1 + segments // 8
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        rounds = _peel(_slots(h, segment, segments), (segments + 2) * segment)
        if rounds is None:
            continue
        slots, prints = _slots(h, segment, segments), _prints(h)
        table = np.zeros((segments + 2) * segment, dtype=np.uint16)
        for key, slot in reversed(rounds):
            # The slot itself is still zero, so all three may be folded in.
            a, b, c = slots[0, key], slots[1, key], slots[2, key]
            table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
        return _HEADER.pack(seed * 0x9E3779B97F4A7C15 % 2**64, segment, segments, n) + table.tobytes()
    raise RuntimeError("no seed gave a filter")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their own slots), or None if the keys can't be ordered."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    order = np.argsort(slots.ravel(), kind="stable")
    owners = order % n
    xors = np.zeros(size, dtype=np.int64)
    used, starts = np.unique(slots.ravel()[order], return_index=True)
    xors[used] = np.bitwise_xor.reduceat(owners, starts)
    left, rounds = n, []
    single = np.flatnonzero(count == 1)
    while len(single):
        keys, first = np.unique(xors[single], return_index=True)
        rounds.append((keys, single[first]))
        left -= len(keys)
        touched = slots[:, keys]
        np.subtract.at(count, touched.ravel(), 1)
        np.bitwise_xor.at(xors, touched.ravel(), np.tile(keys, 3))
        around = np.unique(touched)
        single = around[count[around] == 1]
    return rounds if left == 0 else None


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold; an empty filter holds none."""
    keys = np.asarray(keys, dtype=np.uint64)
    if not data:
        return np.zeros(len(keys), dtype=bool)
    seed, segment, segments, _ = _HEADER.unpack_from(data)
    table = np.frombuffer(data, dtype=np.uint16, offset=_HEADER.size)
    h = _mix(keys, seed)
    a, b, c = _slots(h, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)

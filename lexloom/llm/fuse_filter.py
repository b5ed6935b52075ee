"""Static binary-fuse filters: three probes, eight bits a key, about nine bits a key in all.

A filter is built once over an immutable set of 64-bit keys. It never misses a member and
lets one in 256 others pass. Building peels slots that one key alone maps to, a whole
frontier at a time in numpy, and gives fingerprints in the reverse order.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from lexloom.llm.words import mix

_HEAD = struct.Struct("<QII")


def _seeded(seed: int) -> np.uint64:
    return np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)


def _shape(n: int) -> tuple[int, int]:
    """Segment length and number of segments for n keys."""
    length = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-round(n * factor) // length) - 2)
    return length, segments


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    low = np.uint64(length - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * length)) ^ (h & low)
    return np.stack([first, second, third]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of 64-bit keys; repeats count once, an empty set gives a filter that nothing passes."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return _HEAD.pack(0, 0, 0)
    length, segments = _shape(n)
    for seed in range(1000):
        if seed and seed % 20 == 0:
            segments += max(1, segments // 8)
        h = mix(keys + _seeded(seed + 1))
        slots = _slots(h, length, segments)
        size = (segments + 2) * length
        count = np.bincount(slots.ravel(), minlength=size)
        owners = np.bincount(slots.ravel(), weights=np.tile(np.arange(n), 3), minlength=size).astype(np.int64)
        rounds, front = [], np.flatnonzero(count == 1)
        while len(front):
            key, at = np.unique(owners[front], return_index=True)
            rounds.append((key, front[at]))
            gone = slots[:, key].ravel()
            np.subtract.at(count, gone, 1)
            np.subtract.at(owners, gone, np.tile(key, 3))
            gone = np.unique(gone)
            front = gone[count[gone] == 1]
        if sum(len(k) for k, _ in rounds) == n:
            table = np.zeros(size, np.uint8)
            for key, slot in reversed(rounds):
                a, b, c = slots[:, key]
                table[slot] = _print(h[key]) ^ table[a] ^ table[b] ^ table[c]
            return _HEAD.pack(seed + 1, length, segments) + table.tobytes()
    raise RuntimeError("no seed peels this set")


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether it may be in the set; always true for members."""
    seed, length, segments = _HEAD.unpack_from(blob)
    if not length:
        return np.zeros(len(keys), bool)
    h = mix(keys.astype(np.uint64) + _seeded(seed))
    a, b, c = _slots(h, length, segments)
    table = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    return table[a] ^ table[b] ^ table[c] == _print(h)

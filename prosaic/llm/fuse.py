"""Static binary-fuse filters (three places per key, 16-bit fingerprints), built and probed by whole arrays.

About 1.13 x 16 bits a key; a key that was built in is always found, any other
one with probability 2**-16.
"""

from __future__ import annotations

import math

import numpy as np

from prosaic.llm.bytewords import U64, mix


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = mix(keys + mix(np.array([seed], U64)))
    low = (((h >> U64(32)) * U64(segments * segment)) >> U64(32)).astype(np.int64)
    mask = segment - 1
    second = (low + segment) ^ ((h >> U64(18)).astype(np.int64) & mask)
    third = (low + 2 * segment) ^ (h.astype(np.int64) & mask)
    return low, second, third, (mix(h ^ U64(0x5851F42D4C957F2D)) & U64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, segment length, fingerprints) for the distinct keys given."""
    keys = np.unique(keys.astype(U64))
    n = len(keys)
    if not n:
        return 0, 4, b""
    segment = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-round(n * factor) // segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 1000):
        a, b, c, mark = _places(keys, seed, segment, segments)
        places = np.stack([a, b, c])
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.bincount(places.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
        rounds, left = [], n
        single = np.flatnonzero(count == 1)
        while len(single):
            who, first = np.unique(owner[single], return_index=True)
            rounds.append((who, single[first]))
            left -= len(who)
            for row in places:
                np.subtract.at(count, row[who], 1)
                np.subtract.at(owner, row[who], who)
            touched = np.unique(places[:, who].ravel())
            single = touched[count[touched] == 1]
        if not left:
            break
    else:
        raise RuntimeError("no seed gives a solvable filter")
    table = np.zeros(size, np.uint16)
    for who, slot in reversed(rounds):
        table[slot] = 0
        table[slot] = mark[who] ^ table[a[who]] ^ table[b[who]] ^ table[c[who]]
    return seed, segment, table.tobytes()


def probe(keys: np.ndarray, seed: int, segment: int, fingerprints: bytes) -> np.ndarray:
    """True for every key that was built in, and by chance for few others."""
    table = np.frombuffer(fingerprints, np.uint16)
    if not len(table):
        return np.zeros(len(keys), bool)
    a, b, c, mark = _places(keys.astype(U64), seed, segment, len(table) // segment - 2)
    return (table[a] ^ table[b] ^ table[c]) == mark

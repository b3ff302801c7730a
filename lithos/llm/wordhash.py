"""Words of byte texts and their hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its hash is XXH3 of its
bytes in 128 bits, kept as two lanes of 64; windows roll each lane's word hashes in the
manner of Rabin and Karp, modulo 2^64.
"""

from __future__ import annotations

import re

import numpy as np
from xxhash import xxh3_128_digest

#: Bytes whose words are hashed at a time; a longer text is cut at white space, a longer word stays whole.
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Odd multipliers, one a lane.
_BASE = np.array([0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of h over all bits, one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word, a row of two lanes."""
    found, at = [], 0
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK)
        past = gap.start() if gap else len(data)
        found.append(b"".join(map(xxh3_128_digest, data[at:past].split())))
        at = past
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the window that starts at each word, a row of two lanes; empty if there are too few words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty((0, 2), np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out *= _BASE
        out += words[j : j + n]
    return mix(out)

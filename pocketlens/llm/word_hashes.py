"""Words of many texts as 64-bit hashes, by numpy over their UTF-8 bytes."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Bytes that are hashed at a time; a longer word is cut there.
BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for places in a block."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers, size = np.ones(BLOCK + 1, np.uint64), 1
        with np.errstate(over="ignore"):
            while size < len(powers):
                n = min(size, len(powers) - size)
                powers[size : size + n] = powers[:n] * np.uint64(pow(base, size, 1 << 64))
                size += n
        out.append(powers)
    return out[0], out[1]


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of at most BLOCK bytes."""
    power, inverse = _powers()
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * power[: len(data)], out=sums[1:])
        hashes = (sums[stops] - sums[starts]) * inverse[starts]
        hashes = (hashes + (stops - starts).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return starts, hashes ^ (hashes >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text).

    Words are runs of ASCII letters, digits and bytes of other characters; A-Z and the
    capital letters of Latin-1 are lower-cased.
    """
    joined = b" ".join(texts).translate(_KEEP)
    data = np.frombuffer(joined, np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    if len(capital):
        data = data.copy()
        data[capital] += 0x20
    starts, hashes, a = [], [], 0
    while a < len(data):
        b = min(a + BLOCK, len(data))
        if b < len(data):  # not inside a word, if there is a space
            space = joined.rfind(b" ", a + 1, b)
            b = space if space > 0 else b
        s, h = _block_words(data[a:b])
        starts.append(s + a)
        hashes.append(h)
        a = b
    if not starts:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)

"""Suffix arrays of the pieces of one shard, in numpy.

The windows of ``match`` bytes of all pieces are sorted by Larsson-Sadakane refinement:
positions are ranked by their first 8 bytes, then only positions that still share a rank
are ranked again by the rank ``depth`` bytes further on, which doubles the depth.  As
nothing beyond ``match`` bytes matters, the refinement ends there, and positions too close
to the end of their piece for a depth drop out.
"""

from __future__ import annotations

import numpy as np


def _first_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number (zeros beyond the end)."""
    word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
    return word[: len(data)]


def _ranked(keys: np.ndarray, base: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank by place in the order, whether the rank is shared) of keys; equal keys share the first's rank.

    ``base`` is the first rank of the group that a key belongs to, keys being grouped by it first.
    """
    order = np.argsort(keys, kind="stable") if base is None else np.lexsort((keys, base))
    k = keys[order]
    head = np.r_[True, k[1:] != k[:-1]]
    if base is not None:
        b = base[order]
        group = np.r_[True, b[1:] != b[:-1]]
        head |= group
        start = np.maximum.accumulate(np.where(group, np.arange(len(k)), 0))
        place = b + np.arange(len(k)) - start
    else:
        place = np.arange(len(k))
    rank = place[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
    shared = ~head | np.r_[~head[1:], False]
    return order, rank, shared


def sorted_windows(data: np.ndarray, ends: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows by their ``match`` bytes, rank of each): the suffix array cut to whole windows.

    ``data`` holds the pieces one after the other, ``ends`` the end of its piece for each
    position.  Equal windows share a rank.
    """
    room = ends - np.arange(len(data))
    depth = 8
    rank = np.full(len(data), -1, np.int64)
    live = np.flatnonzero(room >= depth)
    order, r, shared = _ranked(_first_words(data)[live], None)
    rank[live[order]] = r
    open_positions = live[order][shared]
    while depth < match:
        step = min(depth, match - depth)
        open_positions = open_positions[room[open_positions] >= depth + step]
        if not len(open_positions):
            break
        order, r, shared = _ranked(rank[open_positions + step], rank[open_positions])
        rank[open_positions[order]] = r
        open_positions = open_positions[order][shared]
        depth += step
    windows = np.flatnonzero(room >= match)
    windows = windows[np.argsort(rank[windows], kind="stable")]
    return windows, rank[windows]


def common_prefixes(data: np.ndarray, ends: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted window with the one before it, within their pieces (0 for the first).

    Kasai's rule: a window one byte on from another, whose predecessor is also one byte
    on, has a common prefix one shorter.  So only windows where that run begins, or is
    used up, are compared byte by byte (8 at a time).
    """
    before = np.full(len(data), -1, np.int64)
    before[windows[1:]] = windows[:-1]
    at = np.sort(windows[1:])
    prefix = np.zeros(len(data), np.int64)
    if not len(at):
        return np.zeros(len(windows), np.int64)
    words = _first_words(data)
    gap = at - before[at]
    follows = np.r_[False, (at[1:] == at[:-1] + 1) & (gap[1:] == gap[:-1]) & (ends[at[1:]] == ends[at[:-1]])]
    follows &= ends[before[at]] == np.r_[-1, ends[before[at[:-1]]]]
    todo = ~follows
    match_end = np.zeros(len(at), np.int64)
    run = np.cumsum(todo) - 1
    heads = np.flatnonzero(todo)
    match_end[heads] = at[heads] + _compare(words, ends, at[heads], before[at[heads]])
    length = match_end[heads][run] - at
    spent = length < 0
    if spent.any():
        length[spent] = _compare(words, ends, at[spent], before[at[spent]])
    prefix[at] = length
    return prefix[windows]


def _compare(words: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, each up to the end of its piece."""
    limit = np.minimum(ends[a] - a, ends[b] - b)
    length = np.zeros(len(a), np.int64)
    todo = np.flatnonzero(limit > 0)
    while len(todo):
        differ = words[a[todo] + length[todo]] ^ words[b[todo] + length[todo]]
        equal = differ == 0
        # leading zero bytes of the difference
        zeros = np.zeros(len(todo), np.int64)
        for size in (4, 2, 1):
            none = differ >> np.uint64(64 - 8 * size) == 0
            zeros += np.where(none, size, 0)
            differ = np.where(none, differ << np.uint64(8 * size), differ)
        length[todo] = np.minimum(length[todo] + np.where(equal, 8, zeros), limit[todo])
        todo = todo[equal & (length[todo] < limit[todo])]
    return length


def repeated_windows(data: np.ndarray, ends: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows in sorted order, whether each one's bytes stand at another place as well)."""
    windows, _ = sorted_windows(data, ends, match)
    same = common_prefixes(data, ends, windows) >= match
    return windows, same | np.r_[same[1:], False][: len(same)]

"""Suffix arrays of byte strings by two-stage sorting.

A suffix that is smaller than its successor (type S) is sorted directly; the
others (type L) follow from them by one scan over the buckets of first bytes: a
suffix met in the scan puts its predecessor, if that is of type L, at the next
place of the predecessor's bucket. The scan goes bucket by bucket in numpy.
Order is exact to `depth` bytes; beyond that ties keep an arbitrary order.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

#: Bytes compared first; the rest only where these are equal.
FIRST = 48




def small_types(flat: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor."""
    n = len(flat)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(flat[1:].astype(np.int16) - flat[:-1].astype(np.int16))
    step[-1] = -1  # the last suffix is larger than the empty one
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _sorted_directly(text: bytes, places: list[int], depth: int) -> np.ndarray:
    heads = [text[i : i + FIRST] for i in places]
    order = sorted(range(len(places)), key=heads.__getitem__)
    out = [places[i] for i in order]
    heads = [heads[i] for i in order]
    tied = np.flatnonzero([a == b for a, b in pairwise(heads)])
    if len(tied) and depth > FIRST:
        cuts = np.flatnonzero(np.diff(tied) > 1)
        firsts = tied[np.concatenate([[0], cuts + 1])].tolist()
        lasts = (tied[np.concatenate([cuts, [len(tied) - 1]])] + 2).tolist()
        for a, b in zip(firsts, lasts):
            out[a:b] = sorted(out[a:b], key=lambda i: text[i + FIRST : i + depth])
    return np.array(out, np.int64)


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(text, np.uint8)
    small = small_types(flat)
    direct = _sorted_directly(text, np.flatnonzero(small).tolist(), depth)
    first = flat[direct]
    bounds = np.searchsorted(first, np.arange(257))
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[flat[-1]].append(np.array([len(text) - 1]))
    out = []

    def put_predecessors(met: np.ndarray, bucket: int) -> np.ndarray:
        """Places the predecessors of type L; returns those of this bucket."""
        before = met[met > 0] - 1
        before = before[~small[before]]
        chars = flat[before]
        higher = chars > bucket
        above, keys = before[higher], chars[higher]
        order = np.argsort(keys, kind="stable")
        above, keys = above[order], keys[order]
        if len(keys):
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for a, b in pairwise(cuts.tolist()):
                large[keys[a]].append(above[a:b])
        return before[~higher]

    for bucket in range(256):
        wave = np.concatenate(large[bucket]) if large[bucket] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = put_predecessors(wave, bucket)
        own = direct[bounds[bucket] : bounds[bucket + 1]]
        if len(own):
            out.append(own)
            put_predecessors(own, bucket)
        large[bucket] = []
    return np.concatenate(out)


def common_prefixes(text: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, up to depth, that each suffix shares with the next in the order."""
    n = len(order) - 1
    if n < 1:
        return np.zeros(max(0, n), np.int64)
    padded = np.frombuffer(text + bytes(depth + 8), np.uint8)
    a, b = order[:-1], order[1:]
    found = np.full(n, depth, np.int64)
    live = np.arange(n)
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    for at in range(0, depth, 8):
        x = words[a[live] + at].view(np.uint64)[:, 0]
        y = words[b[live] + at].view(np.uint64)[:, 0]
        differ = x != y
        if differ.any():
            z = (x ^ y)[differ]
            low = z & (~z + np.uint64(1))  # the first differing byte, as numbers are little-endian
            same = (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
            found[live[differ]] = np.minimum(depth, at + same)
            live = live[~differ]
        if not len(live):
            break
    limit = len(text) - np.maximum(a, b)
    return np.minimum(found, limit)

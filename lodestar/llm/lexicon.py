"""Words of texts as numbers, for operators that work on whole batches in numpy."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash

#: Different words that one task remembers, if nothing else is said; then it starts anew.
WORDS = 400_000
#: Keys that enter a table together.
STEP = 1 << 18


class Lexicon:
    """Gives each word it meets a number, and keeps the words' hashes by number.
    A number holds until `room()` starts anew."""

    def __init__(self, most: int = WORDS):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.hashes = np.zeros(0, np.uint64)
        self.words: list[bytes] = []

    def room(self) -> bool:
        """Starts anew if there are too many words; whether it did."""
        if len(self.numbers) > self.most:
            self.clear()
            return True
        return False

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of all words in order, words of each text, and the words not met before."""
        known = len(self.numbers)
        get = self.numbers.__getitem__
        flat = [get(word) for words in texts for word in words]
        new = list(self.numbers)[known:] if len(self.numbers) > known else []
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)])
        return np.array(flat, np.int64), np.array([len(words) for words in texts], np.int64), new


def mixed(*parts: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit hash from several, the order counting; start: the hash of those before."""
    h = np.zeros(parts[0].shape, np.uint64) if start is None else start
    for part in parts:
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


#: ASCII white space, as bytes.split() has it, the masks of a block's first bytes, and the bytes from which a word is hashed by itself.
WHITE, MASKS, LONG = np.isin(np.arange(256), list(b" \t\n\r\v\f")), np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 512


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (bytes, none null) in order, and how many words each text
    has; the words are those of bytes.split(). Words of up to 8 bytes and one length differ in hash."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(int(ends[-1] - ends[0]) + 8, np.uint8)
    if len(data) == 8:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inner = ~WHITE[data[:-8]]
    edge = np.zeros(len(inner) + 1, bool)  # between these and their neighbours no word goes on
    edge[ends] = True
    joined = inner[1:] & inner[:-1] & ~edge[1:-1]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    start, n = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = np.diff(np.searchsorted(start, ends))
    n -= start
    blocks = np.ndarray(len(inner) + 1, np.uint64, data, strides=(1,))
    h = mixed(n.astype(np.uint64), blocks[start] & MASKS[np.minimum(n, 8)])
    more, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(more):
        h[more] = mixed(blocks[start[more] + k] & MASKS[np.minimum(n[more] - k, 8)], start=h[more])
        k += 8
        more = more[n[more] > k]
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + n[i]].tobytes())
    return h, sizes


class Table:
    """64-bit keys to row numbers of a table; linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (len(keys) * 4 // 3).bit_length())  # at most three quarters full
        self.mask = (1 << self.bits) - 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        for start in range(0, len(keys), STEP):
            rows = np.arange(start, min(start + STEP, len(keys)), dtype=np.int32)
            at = self._slot(keys[start : start + STEP])
            while len(rows):
                free = self.slots[at] < 0
                self.slots[at[free]] = rows[free]
                lost = self.slots[at] != rows
                rows, at = rows[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._slot(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.slots[at[open_]]
            found = out[open_]
            open_ = open_[(found >= 0) & (self.keys[found] != keys[open_])]
        return out

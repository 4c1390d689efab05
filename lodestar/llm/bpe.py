"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

The text is cut by the tokenizer's pattern. Pieces not met before are sorted
into buckets of equal padded length; each bucket is a matrix of token ids with
one row per piece. In each round every row merges its leftmost pair of minimum
rank, looked up in an open-addressing hash table of pairs; rows without a pair
left leave the matrix, which is compacted by one column. Pieces longer than
MATRIX_BYTES take the same merges from a heap, so that one very long word costs
n log n and not n squared.

Defined cases: a null text is the empty text (no ids, empty decoded bytes); an
empty table gives an empty table; repeated rows give repeated rows; further
columns are kept, and an output column replaces a column of the same name.
Special tokens are never produced: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Above this length, a piece's merges are taken from a heap.
MATRIX_BYTES = 256
#: Pieces remembered by one Python worker.
CACHE_PIECES = 200_000
#: Characters handled at a time, so that a batch's pieces stay small in memory.
CHUNK_CHARS = 1_500_000
NONE = np.int32(2**31 - 1)

OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "n_tokens": (T.LongType(), pa.int64()),
    "decoded": (T.BinaryType(), pa.binary()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> merged id, in a linear-probing hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.bits = max(4, int(len(merged) * 2.5).bit_length())
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == np.uint64(2**64 - 1)
            self.keys[slots[free]] = keys[free]
            won = free & (self.keys[slots] == keys)
            self.values[slots[won]] = values[won]
            keys, values = keys[~won], values[~won]
            slots = (slots[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such pair; -1 is padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NONE)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[at].astype(np.uint64) << np.uint64(32)) | right[at].astype(np.uint64)
        slots = self._slot(keys)
        while len(at):
            found = self.keys[slots]
            hit = found == keys
            out[at[hit]] = self.values[slots[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            at, keys = at[more], keys[more]
            slots = (slots[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def one(self, a: int, b: int) -> int:
        return int(self.find(np.array([a], np.int32), np.array([b], np.int32))[0])


class Codec:
    """Encodes and decodes with the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the ranks lack some single bytes")
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces, as little-endian bytes, into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                self.cache[piece] = self.long_piece(raw)
            else:
                n = len(raw)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append((piece, raw))
        for width, rows in buckets.items():
            step = max(1, 400_000 // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for (piece, _), ids in zip(part, self.merge([raw for _, raw in part], width)):
                    self.cache[piece] = ids

    def merge(self, raws: list[bytes], width: int) -> list[bytes]:
        flat = np.frombuffer(b"".join(raw.ljust(width, b"\0") for raw in raws), np.uint8)
        ids = self.byte_ids[flat].reshape(len(raws), width)
        lengths = np.array([len(raw) for raw in raws])
        ids[np.arange(width) >= lengths[:, None]] = -1
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * len(raws)
        rows = np.arange(len(raws))
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            each = np.arange(len(rows))
            least = rank[each, at] if rank.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                for row, left in zip(rows[done].tolist(), ids[done]):
                    out[row] = left[left >= 0].astype("<i4").tobytes()
                rows, ids, rank, at, least = rows[~done], ids[~done], rank[~done], at[~done], least[~done]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            width = ids.shape[1]
            ids[each, at] = least
            ids = ids[np.arange(width) != (at + 1)[:, None]].reshape(len(rows), width - 1)
            rank = rank[np.arange(width - 1) != at[:, None]].reshape(len(rows), width - 2)
            before, after = at > 0, at < width - 2
            rank[each[before], at[before] - 1] = self.pairs.find(ids[each[before], at[before] - 1], least[before])
            rank[each[after], at[after]] = self.pairs.find(least[after], ids[each[after], at[after] + 1])
        return out

    def long_piece(self, raw: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = rank, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := self.pairs.one(ids[x], ids[y])) != NONE:
                    heapq.heappush(heap, (found, x, ids[x], ids[y]))
        return np.array([x for x in ids if x is not None], "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [self.split(text) for text in texts]
        new = {piece for pieces in cut for piece in pieces} - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = {piece for pieces in cut for piece in pieces}
        self.learn(new)
        ids = self.cache.__getitem__
        return [b"".join(map(ids, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<i4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(packed: tuple[str, dict[bytes, int]], pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = (packed[0], pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(packed[1], pattern)
    return _codecs[key]


def _share(df: DataFrame, ranks: dict[bytes, int]):
    digest = hashlib.sha256(b"".join(sorted(ranks))).hexdigest()
    return df.sparkSession.sparkContext.broadcast((digest, ranks))


def _output(df: DataFrame, added: list[str]) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c not in added]
    fields = [df.schema[c] for c in kept] + [T.StructField(c, OUTPUTS[c][0]) for c in added]
    return kept, T.StructType(fields)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _with(batch: pa.RecordBatch, kept: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + list(added.values()), names=kept + list(added))


def encode(
    df: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    outputs: tuple[str, ...] = ("ids", "n_tokens"),
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df with the columns named in outputs (any of OUTPUTS), made from the
    text's ids; columns in drop are read but not returned. The vocabulary is
    broadcast: its size is that of the rank file, whatever the corpus."""
    outputs = list(outputs)
    kept, schema = _output(df.drop(*drop) if drop else df, outputs)
    shared = _share(df, ranks)
    decodes = any(c.startswith("decoded") for c in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        make = {
            "ids": lambda ids, raw: np.frombuffer(ids, "<i4"),
            "n_tokens": lambda ids, raw: len(ids) // 4,
            "decoded": lambda ids, raw: raw,
            "ids_sha256": lambda ids, raw: hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": lambda ids, raw: hashlib.sha256(raw).hexdigest(),
        }
        for whole in batches:
            start = 0
            for texts in _groups([x or "" for x in whole.column(text).to_pylist()]):
                batch = whole.slice(start, len(texts))
                start += len(texts)
                rows = [(ids, codec.decode(ids) if decodes else b"") for ids in codec.encode(texts)]
                yield _with(batch, kept, {c: pa.array([make[c](*row) for row in rows], OUTPUTS[c][1]) for c in outputs})

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """df with `decoded`, the bytes that the ids stand for (null ids: empty).
    An id outside the vocabulary is an error."""
    kept, schema = _output(df, ["decoded"])
    shared = _share(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in shared.value[1].items()}
        for batch in batches:
            raw = [b"".join(tokens[i] for i in row or ()) for row in batch.column(ids).to_pylist()]
            yield _with(batch, kept, {"decoded": pa.array(raw, pa.binary())})

    return df.mapInArrow(run, schema)

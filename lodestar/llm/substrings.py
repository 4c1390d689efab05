"""Removal of repeated passages: every byte in a string of `length` bytes that
also starts elsewhere in the corpus.

Every window of `length` bytes is assigned to the least hash of the K-grams in
it (its anchor), which depends on the window's bytes alone, so equal windows have
equal anchors at equal offsets. Windows that follow each other and share an
anchor make a region, about one per 150 bytes. Regions are counted by their
bytes' digest: a region that occurs twice is repeated as a whole. Of each
distinct region under an anchor with several, one copy goes to the anchor's
task, where the suffix array of the regions is built in two stages and adjacent
suffixes that share `length` bytes show the windows repeated in part.

Anchors with more than GROUP distinct regions are not gathered in one task:
there each window's digest is counted instead, which is as exact.

Defined cases: a null text is empty; a text shorter than `length` keeps all; a
repeated row (same id and text) is an occurrence of its own; an empty table
gives an empty table; matches never cross documents; windows are judged on the
input, and overlapping ones within a document count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import is_small, persist, raw_text
from lodestar.llm.fingerprint import BASE, Powers
from lodestar.llm.suffixes import common_prefixes, suffix_array

#: Bytes of an anchor.
K = 64
#: Most distinct regions of one anchor that meet in a task.
GROUP = 4096
#: Offsets from the anchor that are looked at together before sorting.
BLOCK = 16
#: Bytes of the text that one suffix array is built over, if no group is larger.
CHUNK = 1_000_000
PLACE = np.uint64((1 << 28) - 1)
POWERS = Powers(BASE)


def regions_of(raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    """first start, last start, anchor's place, anchor's hash of each region."""
    n = len(raw)
    power, inverse = POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[K:] - sums[:-K]) * inverse[: n - K + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h & ~PLACE) | np.arange(n - K + 1, dtype=np.uint64)
    width, whole = 1, length - K + 1
    while width * 2 <= whole:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < whole:
        least = np.minimum(least[: len(least) - (whole - width)], least[whole - width :])
    place = (least & PLACE).astype(np.int64)
    cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts - 1, [len(place) - 1]])
    return first, last, place[first], h[place[first]]


def _regions(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys)), pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(lasts), pa.int32()),
                pa.array(np.concatenate(offsets), pa.int32()), pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.array(digests, np.uint64).view(np.int64)),
            ], names=["key", "first", "last", "offset", "anchor", "digest"])

        for batch in batches:
            keys, firsts, lasts, offsets, anchors, digests = [], [], [], [], [], []
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("raw").to_pylist()):
                first, last, place, h = regions_of(raw, length)
                digests += [
                    xxhash.xxh3_64_intdigest(raw[a : b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist())
                ]
                keys.append(np.full(len(first), key, np.int64))
                firsts.append(first)
                lasts.append(last)
                offsets.append(place - first)
                anchors.append(h)
                if len(digests) > 100_000:
                    yield out()
                    keys, firsts, lasts, offsets, anchors, digests = [], [], [], [], [], []
            if keys:
                yield out()

    long_enough = docs.filter(F.octet_length("raw") >= length).select("key", "raw")
    return long_enough.mapInArrow(run, "key long, first int, last int, offset int, anchor long, digest long")


def repeated_starts(regions: list[tuple[int, int, bytes]], length: int) -> list[np.ndarray]:
    """For each (group, offset of the anchor, bytes) the starts within the bytes
    whose window also starts in another of them or elsewhere in it. Regions of
    a group share an anchor."""
    flat = np.frombuffer(b"".join(r[2] for r in regions), np.uint8)
    sizes = np.array([len(r[2]) for r in regions])
    base = np.cumsum(sizes) - sizes
    group, offset = np.array([r[0] for r in regions]), np.array([r[1] for r in regions])
    highest, lowest = offset, offset - (sizes - length)
    # blocks of offsets; what all windows of a block share must itself be repeated
    top, bottom = highest // BLOCK, np.floor_divide(lowest, BLOCK)
    count = top - bottom + 1
    of = np.repeat(np.arange(len(regions)), count)
    block = np.repeat(top, count) - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    start = base[of] + offset[of] - block * BLOCK
    power, inverse = POWERS.upto(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)], out=sums[1:])
    core = (sums[start - (BLOCK - 1) + length] - sums[start]) * inverse[start]
    order = np.lexsort((core, block, group[of]))
    same = (core[order][1:] == core[order][:-1]) & (block[order][1:] == block[order][:-1]) & (group[of][order][1:] == group[of][order][:-1])
    live = np.zeros(len(of), bool)
    live[order[1:][same]] = True
    live[order[:-1][same]] = True
    # first and last start (within the region) of each live block, neighbours joined
    a = np.maximum(offset[of] - block * BLOCK - (BLOCK - 1), 0)
    b = np.minimum(offset[of] - block * BLOCK, sizes[of] - length)
    pieces: list[tuple[int, int, int]] = []
    for r, x, y in zip(of[live].tolist(), a[live].tolist(), b[live].tolist()):
        if pieces and pieces[-1][0] == r and pieces[-1][2] + 1 == x:
            pieces[-1] = (r, pieces[-1][1], y)
        else:
            pieces.append((r, x, y))
    out: list[list[int]] = [[] for _ in regions]
    if not pieces:
        return [np.zeros(0, np.int64) for _ in regions]
    text = b"".join(regions[r][2][x : y + length] for r, x, y in pieces)
    spans = np.array([y - x + length for _, x, y in pieces])
    begins = np.cumsum(spans) - spans
    counts = spans - length + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.full(len(text), -1, np.int64)
    owner[begins[piece] + within] = np.arange(len(piece))
    order = suffix_array(text, length)
    order = order[owner[order] >= 0]  # windows that lie in one region
    repeated = np.flatnonzero(common_prefixes(text, order, length) >= length)
    hit = np.unique(owner[order[np.concatenate([repeated, repeated + 1])]])
    firsts = np.array([x for _, x, _ in pieces])
    rows = np.array([r for r, _, _ in pieces])
    for r, s in zip(rows[piece[hit]].tolist(), (firsts[piece[hit]] + within[hit]).tolist()):
        out[r].append(s)
    return [np.array(sorted(x), np.int64) for x in out]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(), starts[np.concatenate([cuts, [len(starts) - 1]])].tolist()))


def _sorted_groups(pieces: DataFrame, length: int) -> DataFrame:
    """key, first, last: repeated starts found among the regions of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, groups, anchor = 0, 0, None

        def out() -> pa.RecordBatch:
            found = repeated_starts([(g, o, raw) for g, _, _, o, raw in held], length)
            rows = [(key, first + a, first + b) for (_, key, first, _, _), starts in zip(held, found) for a, b in _ranges(starts)]
            key, first, last = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["key", "first", "last"])

        for batch in batches:
            for a, key, first, offset, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "first", "offset", "piece"))):
                if a != anchor:
                    anchor, groups = a, groups + 1
                    if size >= CHUNK:
                        yield out()
                        held, size = [], 0
                held.append((groups, key, first, offset, raw))
                size += len(raw)
        if held:
            yield out()

    sorted_ = pieces.repartition("anchor").sortWithinPartitions("anchor")
    return sorted_.mapInArrow(run, "key long, first int, last int")


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """key, first, window (a digest): each window of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, first, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "piece"))):
                n = len(raw) - length + 1
                digests = [xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(digests, pa.binary())], names=["key", "first", "window"])

    return pieces.mapInArrow(run, "key long, first int, window binary")


def repeated_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """key, first, last: ranges of starts of repeated windows. docs: key, any
    other columns, and last raw."""
    regions = persist(_regions(docs, length), "regions")
    here = F.struct("key", "first", "last", "offset").alias("one")
    distinct = persist(regions.select("anchor", "digest", here).groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min("one").alias("one")), "distinct")
    # either side of these joins grows with the corpus, so none is broadcast
    twice = distinct.filter("n > 1").select("anchor", "digest").hint("merge")
    whole = regions.join(twice, ["anchor", "digest"], "left_semi").select("key", "first", "last")
    several = persist(distinct.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    parts = distinct.join(several.hint("merge"), "anchor").select("anchor", "m", "one.*")
    wanted = persist(parts, "wanted")

    of = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "m", "first", "last", "offset")).alias("of"))
    # the bytes of these regions, from their documents. All readers of the texts join
    # the same columns by key in one plan, so that Spark shuffles the texts once
    both = docs.join(of.hint("merge"), "key").select(
        *docs.columns[:-1],
        F.explode(F.transform("of", lambda r: F.struct(
            r["anchor"].alias("anchor"), r["m"].alias("m"), r["first"].alias("first"), r["offset"].alias("offset"),
            F.substr(F.col("raw"), r["first"] + 1, r["last"] - r["first"] + length).alias("piece"),
        ))).alias("r"),
    )
    cut = both.select(*docs.columns[:-1], "r.*")
    found = whole.unionByName(_sorted_groups(cut.filter(F.col("m") <= GROUP), length))
    if not is_small(wanted.filter(F.col("m") > GROUP), 0):
        windows = _windows(cut.filter(F.col("m") > GROUP), length)
        twice = windows.groupBy("window").count().filter("count > 1").select("window").hint("merge")
        found = found.unionByName(windows.join(twice, "window", "left_semi").select("key", "first", F.col("first").alias("last")))
    return found


def remove_repeats(docs: DataFrame, length: int = 400, keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Per document: the columns in keep, n_bytes, n_removed, n_spans,
    kept_sha256, and (with_text) kept, the remaining bytes. docs: doc_id, text."""
    made = docs.select(F.xxhash64("doc_id", "text").alias("key"), *keep, raw_text().alias("raw"))
    ranges = repeated_ranges(made, length)
    of = ranges.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    both = made.join(of.hint("merge"), "key", "left").select(*keep, "raw", "ranges.first", "ranges.last")
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    added += [("kept", T.BinaryType())] if with_text else []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(*x) for x in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for raw, first, last in zip(*(batch.column(c).to_pylist() for c in ("raw", "first", "last"))):
                kept, removed, spans, end = [], 0, 0, 0
                for a, b in sorted(zip(first or (), last or ())):
                    b += length
                    if a > end or not spans:
                        kept.append(raw[end:a])
                        spans += 1
                        removed += b - a
                    elif b > end:
                        removed += b - end
                    end = max(end, b)
                kept.append(raw[end:])
                rest = b"".join(kept)
                for column, value in zip(columns, (len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest)):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + arrays[: len(added)], names=schema.names)

    return both.mapInArrow(run, schema)

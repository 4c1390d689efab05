"""Document fingerprints: sets of content-defined chunks, weighted by length.

A gear hash of the last 16 bytes cuts a text where its high bits are zero. The
cut is normalised: a stricter mask before the usual chunk length and a looser
one after it, with a least and a greatest length. A change moves only the cuts
near it, so the chunks beyond are found again wherever they stand. The
fingerprint is the set of (32-bit digest, length) of the chunks, written as hex
in order; containment is the share of a set's length that another set holds.

Defined cases: a null text is empty; an empty text has the empty fingerprint,
which is like another empty one (1) and unlike any other (0); a text shorter
than the least length is one chunk; repeated chunks count once; an empty table
gives an empty table. Documents are ordered by descending id, null ids last,
rows of one id by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import groups, raw_text

LEAST, USUAL, GREATEST = 16, 32, 128
STRICT, LOOSE = np.uint16(0xFC00), np.uint16(0xF000)
WINDOW = 16
#: Bytes handled at a time.
STEP = 2_000_000
BASE = 0x2545F4914F6CDD1D


def _gear() -> np.ndarray:
    """Spread bits for each byte value; 0 for byte 0, which also parts texts."""
    x = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.uint16)


GEAR = _gear()


class Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            for i, base in enumerate(self.bases):
                have = self.tables[i]
                step = np.uint64(pow(base, len(have), 1 << 64))
                self.tables[i] = np.concatenate([have, have * step])
        return self.tables


POWERS = Powers(BASE)


def chunk_sets(raws: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct chunks, as digest << 8 | length - 1."""
    gap = bytes(WINDOW)
    flat = np.frombuffer(gap.join([b"", *raws]), np.uint8)
    starts, at = [], 0
    for raw in raws:
        at += WINDOW
        starts.append(at)
        at += len(raw)
    n = len(flat)
    h = GEAR[flat]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
        width *= 2
    far = n + GREATEST
    places = np.arange(n, dtype=np.int32)

    def following(mask: np.uint16) -> np.ndarray:
        """The next cut at or after each place."""
        cut = np.where(h & mask == 0, places, np.int32(far))
        out = np.full(n + GREATEST + 1, far, np.int32)
        out[:n] = np.minimum.accumulate(cut[::-1])[::-1]
        return out

    strict, loose = following(STRICT), following(LOOSE)
    early = strict[LEAST - 1 : LEAST - 1 + n]
    ends = np.where(
        early < places + (USUAL - 1), early + 1, np.minimum(loose[USUAL - 1 : USUAL - 1 + n] + 1, places + GREATEST)
    ).tolist()
    firsts, lasts, counts = [], [], []
    for start, raw in zip(starts, raws):
        end, before = start + len(raw), len(firsts)
        while start < end:
            firsts.append(start)
            start = ends[start]
            lasts.append(start)
        if len(firsts) > before:
            lasts[-1] = end
        counts.append(len(firsts) - before)
    power, inverse = POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    a, b = np.array(firsts, np.int64), np.array(lasts, np.int64)
    digest = (sums[b] - sums[a]) * inverse[a]
    digest = (digest ^ (digest >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    items = (digest >> np.uint64(32) << np.uint64(8)) | (b - a - 1).astype(np.uint64)
    out, at = [], 0
    for count in counts:
        out.append(np.unique(items[at : at + count]))
        at += count
    return out


def to_text(chunks: np.ndarray) -> str:
    return (chunks << np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """How much of a, by length, is in b."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = lambda x: int((x & np.uint64(255)).sum()) + len(x)
    return weight(np.intersect1d(a, b, assume_unique=True)) / weight(a)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `fingerprint`; a map without a shuffle."""
    names = [c for c in docs.columns if c != "fingerprint"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("__raw").to_pylist()
            found = [to_text(x) for _, part in groups(raws, STEP) for x in chunk_sets(part)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(found, pa.string())], names=[*names, "fingerprint"])

    return docs.select(*names, raw_text(text).alias("__raw")).mapInArrow(run, schema)


def _in_blocks(docs: DataFrame) -> DataFrame:
    """The documents in blocks of neighbouring ids, each block followed by a
    copy of the first document of the next (`extra`). Blocks are bounds on the
    id column alone; their number is four per shuffle partition."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(bounds))
    block = F.lit(0)
    if cuts:
        block = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("doc_id"))), F.lit(0))
    placed = docs.withColumn("block", F.greatest(block, F.lit(0)))
    heads = sorted(placed.groupBy("block").agg(F.max("doc_id").alias("head")).collect(), reverse=True, key=lambda r: r.block)
    if not heads:
        return placed.withColumn("extra", F.lit(False))
    follows = [(r.head, before.block) for r, before in zip(heads, [heads[-1], *heads[:-1]])]
    to = F.broadcast(spark.createDataFrame(follows, T.StructType([T.StructField("head", docs.schema["doc_id"].dataType), T.StructField("to", T.IntegerType())])))
    extra = docs.join(to, F.col("doc_id").eqNullSafe(F.col("head"))).select(*docs.columns, F.col("to").alias("block"), F.lit(True).alias("extra"))
    both = placed.withColumn("extra", F.lit(False)).unionByName(extra)
    return both.repartition("block").sortWithinPartitions("block", "extra", F.desc_nulls_last("doc_id"), "text")


def _edit(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]




def edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and that of its edited text (the last third
    of its code points replaced from the next document, by descending id; after
    the last comes the first), and how far the fingerprint is contained in
    those of the edited text and of the next document. docs: doc_id, text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = docs.schema["doc_id"]
    schema = T.StructType([key]).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string")
    schema = schema.add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def rows(ids: list, texts: list[str], nexts: list[str], own: list, after: list) -> pa.RecordBatch:
        changed = [_edit(a, b) for a, b in zip(texts, nexts)]
        raws = [x.encode() for x in changed]
        sets = chunk_sets(raws)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, from_arrow), pa.array(map(len, texts), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in raws]), pa.array(map(to_text, own), pa.string()),
            pa.array(map(to_text, sets), pa.string()), pa.array(map(containment, own, sets), pa.float64()),
            pa.array(map(containment, own, after), pa.float64()),
        ], names=schema.names)

    from_arrow = pa.int64() if isinstance(key.dataType, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next has not been met: block, id, text, chunks
        for batch in batches:
            every = list(zip(batch.column("block").to_pylist(), batch.column("extra").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
            for start, part in groups([r[3] for r in every], STEP):
                sets = chunk_sets([x.encode() for x in part])
                ready: list[tuple] = []
                for (block, extra, doc_id, text), chunks in zip(every[start : start + len(part)], sets):
                    if held is not None and held[0] == block:
                        ready.append((held[1], held[2], text, held[3], chunks))
                    held = None if extra else (block, doc_id, text, chunks)
                if ready:
                    yield rows(*map(list, zip(*ready)))

    return _in_blocks(docs).mapInArrow(run, schema)

"""Importance resampling towards the distribution of a target.

Features are runs of up to `longest` consecutive words, hashed into buckets. What a
bucket gains is the logarithm of its share of the target over its share of the
corpus; a text's weight is the sum over its features, and the texts with the
highest weights plus a Gumbel number from their id are drawn: sampling without
replacement in proportion to the weights.

Inside a task, the words of some texts get numbers, and a suffix array of the
numbers (to the depth of the longest run) puts equal runs of words side by side.
Common prefixes of neighbours part the array into runs of one n-gram each; the
n-gram is hashed once, and its bucket goes back to all places where it occurs.
Counts leave a task as one number a bucket; gains, one number a bucket, are
broadcast (their number is the parameter `buckets`). The order of the drawn
comes from a range partitioning and one offset a partition.

Defined cases: a null or empty text has no words; texts without features have
weight 0; no n-gram passes the end of a text; an empty corpus, target or both give
the gains of the formula with 0; null ids hash as no text; equal scores go to the
smaller id, null ids last; repeated rows are drawn each; an empty table gives an
empty table; columns of docs named like the results are replaced.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import persist, raw_text, slices

#: Bytes of text in one suffix array.
STEP = 4_000_000
#: A-Z lower-cased; other bytes below 128 that are neither digits nor letters part words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def n_gram_buckets(texts: list[list[bytes]], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of 1 to `longest` words, as two arrays."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    flat = np.array([numbers[w] for words in texts for w in words], np.int64)
    vocabulary = list(numbers)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words to the end of the text
    small = np.uint16 if len(vocabulary) < 65_535 else np.int64
    flat = (flat + 1).astype(small)  # 0 stands behind the end

    def key(k: int) -> np.ndarray:
        if not k:
            return flat
        moved = np.zeros(len(flat), small)
        moved[:-k] = flat[k:]
        moved[left <= k] = 0
        return moved

    order = np.arange(len(flat))
    for k in reversed(range(longest)):  # by the last word first, each sort stable
        order = order[np.argsort(key(k)[order], kind="stable")]
    same = np.ones(len(flat), np.bool_)
    same[0] = False
    of, into = [], []
    for n in range(1, longest + 1):
        word = key(n - 1)[order]
        same[1:] &= word[1:] == word[:-1]  # the common prefix with the suffix before is of n words at least
        whole = word > 0
        firsts = np.flatnonzero(~same & whole)
        run = np.cumsum(~same & whole) - 1
        hashed = np.array([zlib.crc32(b" ".join(vocabulary[x - 1] for x in flat[i : i + n].tolist())) % buckets for i in order[firsts].tolist()], np.int64)
        places = order[whole]
        of.append(text[places])
        into.append(hashed[run[whole]])
    return np.concatenate(of), np.concatenate(into)


def _words(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    for start, raws in slices(column, STEP):
        yield start, [raw.translate(FOLD).split() for raw in raws]


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """bucket, n: the n-grams of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, words in _words(batch.column(0)):
                total += np.bincount(n_gram_buckets(words, longest, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return docs.select(raw_text(text).alias("raw")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain (thousandths, rounded down) of every bucket, from the counts of
    the corpus and of the target."""
    spark = corpus.sparkSession
    sides = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = sides.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    each = every.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    whole = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1) * (F.col("all_t") + float(buckets)))
    return each.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or the columns to keep) with n_words, n_features and weight."""
    values = np.zeros(buckets, np.int64)
    for row in gain.collect():  # as many rows as buckets
        values[row.bucket] = row.gain
    shared = docs.sparkSession.sparkContext.broadcast(values)
    added = T.StructType().add("n_words", "long").add("n_features", "long").add("weight", "long")
    names = [c for c in (keep or docs.columns) if c not in added.names]
    schema = T.StructType([docs.schema[c] for c in names] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words in _words(batch.column("__raw")):
                of, into = n_gram_buckets(words, longest, buckets)
                weight = np.zeros(len(words), np.int64)
                np.add.at(weight, of, shared.value[into])
                numbers = np.array([len(w) for w in words], np.int64), np.bincount(of, minlength=len(words)), weight
                part = batch.slice(start, len(words))
                yield pa.RecordBatch.from_arrays([*(part.column(f"__{i}") for i in range(len(names))), *(pa.array(x, pa.int64()) for x in numbers)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)), raw_text(text).alias("__raw")).mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
    key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """docs (or the columns to keep, the key among them) with n_words, n_features, weight,
    score (weight plus the Gumbel number, thousandths) and rank: 1, 2, 3, ... of the
    drawn percentage of the texts of at least so many words, null for the others."""
    gain = gains(bucket_counts(docs, longest, buckets, text), bucket_counts(target, longest, buckets, "text"), buckets)
    found = weighed(docs, gain, longest, buckets, text, keep)
    number = F.coalesce(F.col(key).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), number), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    names = [c for c in found.columns if c not in ("score", "rank")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [(F.col("n_words") >= least_words).desc(), F.col("score").desc(), F.col(key).asc_nulls_last()]
    # written, as the bounds of the ranges are drawn from the rows before these are dealt out
    scored = persist(found.select(*names, (F.col("weight") + gumbel).alias("score")), "weighed")
    # the order is written once: the number holds the partition above bit 33, the place in it below
    placed = persist(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    rows = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("n_words") >= least_words).alias("fit")).collect())
    drawn = sum(r.fit for r in rows) * percent // 100
    before, offsets = 0, []
    for r in rows:  # a number for each partition
        offsets.append((r.part, before))
        before += r.n
    offset = F.broadcast(docs.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("__part", part).join(offset, "__part", "left").select(*names, "score", F.when((F.col("n_words") >= least_words) & (rank <= drawn), rank).alias("rank"))

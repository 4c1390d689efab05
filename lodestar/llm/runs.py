"""Runs of periodic words, found by comparing a text with itself at every lag.

A lag q compares the word numbers with themselves q words on; a stretch of L
equal cells is a run of L + q words with period q. Lags go up to n / exponent,
since a run holds its period that many times. A stretch that a smaller lag has
found with the same ends has that smaller period, so each pair of ends keeps the
least lag.

Texts are compared in slices: the texts of a slice stand one behind the other,
longest first, with word numbers of their own, so that one comparison serves all
texts long enough for the lag. A stretch is measured only where cells at a
quarter of its least length are equal, which any long enough stretch must hold.
A text whose comparisons exceed `WORK` is dealt out by ranges of lags, each to a
task of its own, and the runs found come together by text.

Defined cases: words are what white space (space, \\t to \\r) parts; a null or empty
text has no words and no runs, and collapses to the empty text; a text shorter
than the least length has none; repeated rows are texts each; an empty table gives an
empty table; columns of docs named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import persist, raw_text, slices

#: Bytes of text compared together.
STEP = 1_500_000
#: Comparisons of one range of lags, about; a text of 11,300 words makes as many.
WORK = 64_000_000
RESULTS = T.StructType().add("n_runs", "long").add("start", "long").add("length", "long").add("period", "long").add("exponent_milli", "long").add("runs_sha256", "string").add("collapsed_sha256", "string")
RUNS = "array<struct<start:long,length:long,period:long>>"


def _stretch(same: np.ndarray, cell: int) -> tuple[int, int]:
    """The ends of the equal cells around one."""
    width, end = 64, cell
    while end < len(same):
        part = same[end : end + width]
        stop = int(part.argmin())
        if not part[stop]:
            end += stop
            break
        end, width = end + len(part), width * 2
    width, start = 64, cell
    while start > 0:
        part = same[max(0, start - width) : start][::-1]
        stop = int(part.argmin())
        if not part[stop]:
            start -= stop
            break
        start, width = start - len(part), width * 2
    return start, end


def find_runs(texts: list[list[bytes]], least: int = 12, exponent: int = 2, lags: tuple[int, int] | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) by start, then period; with
    `lags`, only those of the periods in this range (end exclusive)."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    number = count()
    flat = np.empty(int(starts[-1]), np.int32)
    for i, a, b in zip(order, starts[:-1].tolist(), starts[1:].tolist()):
        flat[a:b] = list(map(defaultdict(number.__next__).__getitem__, texts[i]))  # no text shares a number with another
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    cells = np.empty(len(flat), np.bool_)
    longest = int(sizes[0]) if len(sizes) else 0
    first, last = lags or (1, longest + 1)
    fits = np.searchsorted(-sizes, -np.maximum(least, exponent * np.arange(longest + 2)), "right")  # texts long enough for a lag
    ends = starts[fits].tolist()
    for q in range(first, min(last, longest // exponent + 1)):
        n = ends[q] - q
        if n <= 0:
            break
        same = np.equal(flat[:n], flat[q : n + q], out=cells[:n])
        short = max(least - q, (exponent - 1) * q, 1)
        gap = max(1, short // 4)
        probes = same[::gap]
        if short >= 4:
            probes = probes[:-3] & probes[1:-2] & probes[2:-1] & probes[3:]
        hits = np.flatnonzero(probes) * gap
        at = 0
        while at < len(hits):
            a, b = _stretch(same, int(hits[at]))
            if b - a >= short:
                i = int(np.searchsorted(starts, a, "right")) - 1
                begin = a - int(starts[i])
                found[order[i]].setdefault((begin, begin + b - a + q), q)
            at = max(at + 1, int(np.searchsorted(hits, b)))
    return [sorted((a, b - a, q) for (a, b), q in of.items()) for of in found]


def collapse_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), np.bool_)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _told(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()
    kept = b" ".join(collapse_words(words, runs))
    digests = hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()
    return len(runs), *best, best[1] * 1000 // best[2] if runs else None, *digests, runs, kept


def _n_words(text: Column) -> Column:
    """Words, or a few more where white space stands together."""
    return F.length(text) - F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) + 1


def collapse(docs: DataFrame, least: int = 12, exponent: int = 2, text: str = "text", outputs: tuple[str, ...] = ("runs", "collapsed"), drop: tuple[str, ...] = (), work: int = WORK) -> DataFrame:
    """docs (but the columns to drop) with the outputs: n_runs; start, length, period and
    exponent_milli of the longest run (ties: smallest start, then period; nulls
    without a run); runs_sha256 of the lines `start,length,period` and
    collapsed_sha256; `runs` themselves and the `collapsed` text."""
    types = {f.name: f.dataType for f in RESULTS} | {"runs": T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long")), "collapsed": T.StringType()}
    names = [c for c in docs.columns if c not in outputs and c not in drop]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, types[c]) for c in outputs])
    arrow = {"collapsed": pa.string(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))}
    places = [[*RESULTS.names, "runs", "collapsed"].index(c) for c in outputs]

    def rows(kept: pa.RecordBatch, told: list[tuple]) -> pa.RecordBatch:
        made = []
        for c, place in zip(outputs, places):
            values = [t[place] for t in told]
            if c == "runs":
                values = [[dict(zip(("start", "length", "period"), r)) for r in v] for v in values]
            elif c == "collapsed":
                values = [v.decode() for v in values]
            made.append(pa.array(values, arrow.get(c, pa.int64())))
        return pa.RecordBatch.from_arrays([*(kept.column(f"__{i}") for i in range(len(names))), *made], names=schema.names)

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raws in slices(batch.column("__raw"), STEP):
                words = [raw.split() for raw in raws]
                yield rows(batch.slice(start, len(raws)), list(map(_told, words, find_runs(words, least, exponent))))

    def one_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, raw, first, last = (batch.column(c)[row].as_py() for c in ("__key", "__raw", "__first", "__last"))
                (runs,) = find_runs([raw.split()], least, exponent, (first, last))
                made = [[x[i] for x in runs] for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(runs), pa.int64()), *(pa.array(x, pa.int64()) for x in made)], names=["__key", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = batch.column("__runs")[row].as_py() or []
                yield rows(batch.slice(row, 1), [_told(batch.column("__raw")[row].as_py().split(), [(r["start"], r["length"], r["period"]) for r in found])])

    plain = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)), raw_text(text).alias("__raw"), F.coalesce(_n_words(F.col(text)), F.lit(0)).alias("__n"))
    # a lag q makes n - q comparisons, so n lags / exponent make n * n * (exponent - 0.5) / exponent ** 2
    share = (exponent - 0.5) / exponent**2
    heavy = F.col("__n").cast("double") * F.col("__n") * share > work
    short = plain.filter(~heavy).drop("__n").mapInArrow(in_place, schema)
    long = persist(plain.filter(heavy).withColumn("__key", F.monotonically_increasing_id()), "long-texts")
    n = F.ceil(F.col("__n").cast("double") * F.col("__n") * share / work).cast("int")
    width = F.ceil(F.col("__n") / exponent / n).cast("int")
    ranges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * width + 1).alias("a"), ((i + 1) * width + 1).alias("b")))
    dealt = long.select("__key", "__raw", F.explode(ranges).alias("r")).select("__key", "__raw", F.col("r.a").alias("__first"), F.col("r.b").alias("__last"))
    found = dealt.repartition("__key", "__first").mapInArrow(one_range, "__key long, start long, length long, period long")
    least_lag = found.groupBy("__key", "start", "length").agg(F.min("period").alias("period"))
    of_text = least_lag.groupBy("__key").agg(F.collect_list(F.struct("start", "length", "period")).alias("__runs"))
    joined = long.join(of_text, "__key", "left").drop("__key", "__n").mapInArrow(finish, schema)
    return short.unionByName(joined)

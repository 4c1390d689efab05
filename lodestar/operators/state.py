"""Operators whose answer depends on the order of events of a key.

A fold streams over each key's rows in order: keys are dealt to tasks, rows are
sorted there, and only the state of the key at hand is held, however many rows
the key has. Over a stream the same functions give the same answers, row by row, once
the watermark has passed (streaming/ordered.py).
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], begin: Callable[[], object], step: Callable, added: str, columns: dict[str, pa.DataType], needed: list[str] | None = None) -> DataFrame:
    """df with columns that step(state, row) returns (state, values) for; begin() starts a key.
    needed: the columns that step reads, if not all; the others stay in Arrow's memory."""
    if df.isStreaming:
        from lodestar.streaming.ordered import streamed_fold  # only streams need it

        return streamed_fold(df, keys, order, begin, step, T.StructType.fromDDL(added))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            values: list[list] = [[] for _ in columns]
            for row in (batch.select([*dict.fromkeys([*keys, *needed])]) if needed is not None else batch).to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key or state is None:
                    key, state = now, begin()
                state, new = step(state, row)
                for column, value in zip(values, new):
                    column.append(value)
            arrays = [pa.array(v, t) for v, t in zip(values, columns.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *columns])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def quota(requests: DataFrame, limit: float, keys: list[str], order: list[str], cost: str) -> DataFrame:
    """requests with accepted and used: a request over the limit adds nothing,
    so a smaller one after it may pass. A null cost is none."""

    def step(used: float, row: dict) -> tuple[float, tuple]:
        asked = row[cost] or 0.0
        fits = used + asked <= limit
        used = used + asked if fits else used
        return used, (fits, used)

    return ordered_fold(requests, keys, order, float, step, "accepted boolean, used double", {"accepted": pa.bool_(), "used": pa.float64()}, [cost])


def sliding_window(requests: DataFrame, limit: int, seconds: float, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """requests with accepted: at most limit accepted in any span of so many
    seconds; rejected ones do not count. time: seconds."""

    def step(past: deque, row: dict) -> tuple[deque, tuple]:
        while past and past[0] <= row[time] - seconds:
            past.popleft()
        fits = len(past) < limit
        if fits:
            past.append(row[time])
        return past, (fits,)

    return ordered_fold(requests, keys, [time, *order], deque, step, "accepted boolean", {"accepted": pa.bool_()}, [time])


def hourly_limit(requests: DataFrame, limit: int, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """requests with accepted: the first `limit` of each clock hour."""
    hour = F.floor(F.unix_timestamp(time) / 3600)
    place = F.row_number().over(Window.partitionBy(*keys, hour).orderBy(time, *order))
    return requests.withColumn("accepted", place <= limit)


def chain(entries: DataFrame, keys: list[str], order: list[str], payload: str, begin: str | None = None, place: str | None = None) -> DataFrame:
    """entries with prev_hash and entry_hash: each hash covers the one before. A
    null payload is empty. begin and place name columns with the hash that a key's chain
    goes on from and how many entries it has; place then counts on."""
    named = [c for c in (*keys, payload, begin, place) if c]

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        previous, n = state
        if previous is None:
            previous, n = (row[begin] if begin else GENESIS), (row[place] if place else 0)
        new = hashlib.sha256((previous + (row[payload] or "")).encode()).hexdigest()
        return (new, n + 1), (previous, new, n + 1)

    told = ordered_fold(entries, keys, order, lambda: (None, 0), step, "prev_hash string, entry_hash string, __place long", {"prev_hash": pa.string(), "entry_hash": pa.string(), "__place": pa.int64()}, named)
    return told.withColumn(place, F.col("__place")).drop("__place") if place else told.drop("__place")


def verify(entries: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """Per key: entries, and the first place (from 0) at which the chain is
    broken (null: none)."""
    w = Window.partitionBy(key).orderBy(*order)
    checked = entries.select(
        key,
        (F.row_number().over(w) - 1).alias("place"),
        F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS)).alias("expected"),
        "prev_hash",
        "entry_hash",
        F.sha2(F.concat("prev_hash", F.coalesce(payload, F.lit(""))), 256).alias("again"),
    )
    broken = (F.col("expected") != F.col("prev_hash")) | (F.col("again") != F.col("entry_hash"))
    return checked.groupBy(key).agg(F.count("*").alias("n_entries"), F.min(F.when(broken, F.col("place"))).alias("first_broken"))


def deliver(messages: DataFrame, now: str, attempts: int = 3) -> DataFrame:
    """messages with outcome: expired ones are dropped before their signature is
    looked at; bad signatures and too many deliveries go to the dead letters."""
    outcome = (
        F.when(F.col(now) > F.col("sent") + F.col("ttl"), "expired")
        .when(~F.col("valid"), "invalid_signature")
        .when(F.col("failures") >= attempts, "max_delivery_attempts")
        .when(F.col("failures") > 0, "pending")
        .otherwise("acked")
    )
    return messages.withColumn("outcome", outcome)


def trimmed(entries: DataFrame, key: str, newest: list, keep: int = 50) -> DataFrame:
    """The newest entries of each key."""
    return entries.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).filter(F.col("__n") <= keep).drop("__n")


def cached(requests: DataFrame, keys: list[str], time: str, vector: str, least: float, ttl: float, most: int) -> DataFrame:
    """requests with hit_at (time of the entry that answers; null: a miss, which is
    stored) and held (entries then). The newest entry that is at least `least` alike
    answers. A key keeps its `most` newest entries, until `ttl` has passed since its
    last store or a row that invalidates (column invalidates) empties it. A
    null vector misses and is not stored; times must differ within a key."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        entries, stored = state
        at, x = row[time], row[vector]
        if row["invalidates"] or (stored is not None and at - stored >= ttl):
            entries, stored = [], None
        if row["invalidates"] or x is None:
            return (entries, stored), (None, len(entries))
        x = np.array(x, np.float64)
        size = np.sqrt(x @ x)
        for then, y, length in entries:
            if (x @ y / (size * length) if size * length else 0.0) >= least:
                return (entries, stored), (then, len(entries))
        entries = [(at, x, size), *entries[: most - 1]]
        return (entries, at), (None, len(entries))

    kind = requests.schema[time].dataType.simpleString()
    return ordered_fold(requests, keys, [time], lambda: ([], None), step, f"hit_at {kind}, held int", {"hit_at": pa.int64() if kind == "bigint" else pa.float64(), "held": pa.int32()})


def reserve(requests: DataFrame, limit: int, seconds: float, most_wait: float, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """requests with accepted and start (seconds; null if refused): at most
    `limit` starts in any span of so many seconds. A request takes the first free
    start; one that would wait longer than most_wait is refused and takes none."""

    def step(starts: deque, row: dict) -> tuple[deque, tuple]:
        start = max(row[time], starts[0] + seconds) if len(starts) == limit else row[time]
        start = max(start, starts[-1]) if starts else start
        if start - row[time] > most_wait:
            return starts, (False, None)
        starts.append(start)
        return starts, (True, start)

    return ordered_fold(requests, keys, [time, *order], lambda: deque(maxlen=limit), step, "accepted boolean, start double", {"accepted": pa.bool_(), "start": pa.float64()}, [time])


def consumed(stream: DataFrame, keys: list[str], time: str, order: list[str], idle: float = 5.0, attempts: int = 3) -> DataFrame:
    """stream with given (the message a call gets; null: none), tries and dead.

    Rows of a recipient (columns kind, msg): publish puts msg at the end; call asks
    for one message; ack removes msg. A call gets the message that has waited for an
    ack longest, if it was given `idle` seconds ago or before, else the oldest that
    nobody has had. A message that would be given more than `attempts` times goes
    to the dead letters instead (dead), and the call gets none. Nothing but the
    messages in flight is held."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        new, pending = state
        now, kind, msg = row[time], row["kind"], row["msg"]
        if kind == "publish":
            new.append(msg)
        elif kind == "ack":
            pending.pop(msg, None)
        elif pending and now - next(iter(pending.values()))[0] >= idle:
            msg, (_, tries) = next(iter(pending.items()))
            del pending[msg]
            if tries >= attempts:
                return state, (msg, tries, True)
            pending[msg] = now, tries + 1  # at the end: in the order of the last delivery
            return state, (msg, tries + 1, False)
        elif new:
            msg = new.popleft()
            pending[msg] = now, 1
            return state, (msg, 1, False)
        return state, (None, None, False)

    kind = stream.schema["msg"].dataType.simpleString()
    types = {"given": pa.int64() if kind == "bigint" else pa.string(), "tries": pa.int32(), "dead": pa.bool_()}
    return ordered_fold(stream, keys, [time, *order], lambda: (deque(), {}), step, f"given {kind}, tries int, dead boolean", types)


def slots(requests: DataFrame, limit: int, ttl: float, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """requests (holder, release) with granted and held (slots in use after it):
    at most `limit` holders of a key at once, each until it releases its own
    slot or `ttl` seconds have passed; a holder that asks again renews its slot."""

    def step(until: dict, row: dict) -> tuple[dict, tuple]:
        until = {h: end for h, end in until.items() if end > row[time]}
        if row["release"]:
            granted = until.pop(row["holder"], None) is not None
        else:
            granted = row["holder"] in until or len(until) < limit
            if granted:
                until[row["holder"]] = row[time] + ttl
        return until, (granted, len(until))

    return ordered_fold(requests, keys, [time, *order], dict, step, "granted boolean, held int", {"granted": pa.bool_(), "held": pa.int32()})

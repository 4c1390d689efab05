"""Counts of clock hours over a stream, sinks of a delivery, control of running
queries and their progress. Ordered operators take streams themselves
(operators/state.py)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def hourly_counts(requests: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Requests of each key and clock hour; an hour closes once the watermark passes it."""
    hours = requests.withWatermark(time, late).groupBy(F.window(time, "1 hour"), *keys).agg(F.count("*").alias("n"))
    return hours.select(F.col("window.start").alias("hour"), *keys, "n")


def split_sinks(delivered: DataFrame, batch_id: int, folder: str) -> None:
    """For foreachBatch: dead letters to one table, the rest to another. A batch
    that is run again overwrites its own files."""
    dead = F.col("outcome").isin("invalid_signature", "max_delivery_attempts")
    delivered.filter(dead).write.mode("overwrite").parquet(f"{folder}/dead_letters/batch={batch_id}")
    delivered.filter(~dead).write.mode("overwrite").parquet(f"{folder}/messages/batch={batch_id}")


class Progress(StreamingQueryListener):
    """Keeps what running queries report: (query, event, details) in order, as start, stage
    (a batch with its rows), result or error."""

    def __init__(self, most: int = 10_000):
        self.most, self.events = most, []

    def _told(self, query: str, event: str, **details) -> None:
        self.events.append((query, event, details))
        del self.events[: -self.most]

    def onQueryStarted(self, event) -> None:
        self._told(str(event.id), "start", name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._told(str(p.id), "stage", batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._told(str(event.id), "error", message=event.exception)
        else:
            self._told(str(event.id), "result")

    def frames(self) -> list[str]:
        """The events as server-sent text."""
        return [f"event: {event}\ndata: {json.dumps(details, sort_keys=True)}\n\n" for _, event, details in self.events]


def killed(switches: DataFrame, now: float) -> list:
    """Agents whose last message of control (agent, at, kind: set or cleared, until) is a set
    one that has not run out."""
    last = switches.groupBy("agent").agg(F.max_by(F.struct("kind", "until"), "at").alias("last"))
    live = F.col("last.until").isNull() | (F.col("last.until") > F.lit(now))
    return [r.agent for r in last.filter((F.col("last.kind") == "set") & live).select("agent").collect()]


def watch(control: DataFrame, running: dict[str, StreamingQuery], stopped: list, checkpoint: str) -> StreamingQuery:
    """A query over the stream of control messages (agent, at, kind, until) that stops the running
    query of each agent that is set, in the batch that brings the message. Agents are few."""

    def act(batch: DataFrame, batch_id: int) -> None:
        for row in batch.groupBy("agent").agg(F.max_by("kind", "at").alias("kind")).collect():
            query = running.get(row.agent)
            if row.kind == "set" and query is not None and query.isActive:
                query.stop()
                stopped.append((row.agent, batch_id))

    return control.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).start()

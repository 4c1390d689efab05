"""What batches add to stored tables, safe to repeat and to race.

Documents: one for each tenant and content, whoever comes first. Chains: each
tenant's entries go on from its stored head. Caches: the newest entries, the
whole list renewed by each store. Deletes: children, the document, an audit entry, and
then the tenant's cache. Messages: appended.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import canonical
from lodestar.operators import ingest, state
from lodestar.sources.store import Versioned, latest


def insert_documents(table: Versioned, batch_id: str, batch: DataFrame) -> int:
    """Adds the rows of batch (tenant_id, doc_id, content_hash, ...) whose content is new to
    their tenant; who loses a race finds the winner's rows stored."""
    return table.write(batch_id, lambda held: ingest.not_stored(batch, latest(held, batch)))


def heads(entries: DataFrame | None, like: DataFrame, key: str) -> DataFrame:
    """key, head, n: the last hash of each chain and how many entries it has."""
    rows = entries if entries is not None else like.select(key, F.lit(0).cast("long").alias("n"), F.lit("").alias("entry_hash")).limit(0)
    return rows.groupBy(key).agg(F.max_by("entry_hash", "n").alias("head"), F.max("n").alias("n"))


def append_entries(log: Versioned, batch_id: str, entries: DataFrame, key: str, order: list[str], payload: str) -> int:
    """Adds entries with n (from 1 in each chain), prev_hash and entry_hash, going on
    from what is stored."""

    def make(held: DataFrame | None) -> DataFrame:
        last = heads(held, entries, key).select(F.col(key).alias("__key"), "head", F.col("n").alias("__n"))
        joined = entries.join(last, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
        begun = joined.withColumns({"__head": F.coalesce("head", F.lit(state.GENESIS)), "__n": F.coalesce("__n", F.lit(0))}).drop("head")
        return state.chain(begun, [key], order, payload, begin="__head", place="__n").drop("__head").withColumnRenamed("__n", "n")

    return log.write(batch_id, make)


def store_answers(cache: Versioned, batch_id: str, answers: DataFrame, keep: int = 50) -> int:
    """Adds cache entries (tenant_id, at, vector, response), of each tenant the newest
    `keep`, and renews `stored_at`, from which its list lives."""

    def make(held: DataFrame | None) -> DataFrame:
        new = answers.select("tenant_id", "at", "vector", "response")
        every = new if held is None else held.select(*new.columns).unionByName(new)
        newest = state.trimmed(every, "tenant_id", [F.desc("at")], keep)
        stored = new.groupBy("tenant_id").agg(F.max("at").alias("stored_at"))
        if held is not None:
            stored = stored.unionByName(held.select("tenant_id", "stored_at")).repartition("tenant_id").groupBy("tenant_id").agg(F.max("stored_at").alias("stored_at"))
        return newest.join(stored, "tenant_id")

    return cache.write(batch_id, make, replace=True)


def living(cache: DataFrame, now: float, ttl: float = 3600) -> DataFrame:
    """Entries of lists that were stored to less than ttl ago."""
    return cache.filter(F.lit(now) - F.col("stored_at") < ttl)


def delete_documents(documents: Versioned, children: list[tuple[Versioned, str]], log: Versioned, cache: Versioned | None, batch_id: str, gone: DataFrame) -> None:
    """Deletes the documents of gone (tenant_id, doc_id): children (tables and the column that
    names the document) first, then documents, an audit entry for each document that was
    there, and the caches of their tenants. Each step is a batch of its own, so that a
    repeated delete does what is missing."""

    def without(held: DataFrame | None, column: str) -> DataFrame:
        return held.join(gone.select("tenant_id", F.col("doc_id").alias(column)).distinct(), ["tenant_id", column], "left_anti")

    m = documents.manifest()
    before = documents.read(m["batches"].index(batch_id) if batch_id in m["batches"] else None)  # version i holds the first i batches
    for table, column in children:
        if table.version():
            table.write(batch_id, functools.partial(without, column=column), replace=True)
    documents.write(batch_id, lambda held: without(held, "doc_id"), replace=True)
    there = before.join(gone.select("tenant_id", "doc_id").distinct(), ["tenant_id", "doc_id"], "left_semi").select("tenant_id", "doc_id").distinct()
    entries = there.select("tenant_id", "doc_id", F.lit("document.deleted").alias("event_type"), canonical({"document_id": F.col("doc_id")}).alias("event_data"))
    append_entries(log, batch_id, entries, "tenant_id", ["doc_id"], "event_data")
    if cache is not None and cache.version():
        cache.write(batch_id, lambda held: held.join(gone.select("tenant_id").distinct(), "tenant_id", "left_anti"), replace=True)


def publish(bus: Versioned, batch_id: str, messages: DataFrame) -> int:
    """Adds messages (msg_id, sender, recipient, type, payload, sent, ttl) to the bus."""
    return bus.append(batch_id, messages)

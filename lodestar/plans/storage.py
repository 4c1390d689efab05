"""Batches into stored tables, and reads of what earlier batches wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.operators import postings, stored
from lodestar.plans.operations import CHAIN, _entries
from lodestar.plans.registry import query
from lodestar.plans.retrieval import MANY, SPARSE, many_questions, texts
from lodestar.sources.store import Versioned, shared_folder
from lodestar.sources.tables import table


def _table(spark: SparkSession, name: str) -> Versioned:
    return Versioned(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}/{name}")


@query(CHAIN + "SELECT user_id, event_id, n, prev_hash, entry_hash FROM c")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """The chains of all events, stored in three batches by time, each going on from the
    stored heads; one is sent twice."""
    log, entries = _table(spark, "audit"), _entries(spark, d)
    day = F.dayofmonth("ts")
    for name, part in (("a", day <= 10), ("b", (day > 10) & (day <= 20)), ("b", (day > 10) & (day <= 20)), ("c", day > 20)):
        stored.append_entries(log, name, entries.filter(part), "user_id", ["ts", "event_id"], "payload")
    return log.read().select("user_id", "event_id", "n", "prev_hash", "entry_hash")


@query("""
SELECT source AS tenant_id, sha256(text) AS content_hash, doc_id FROM documents WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id % 3, doc_id) = 1""")
def ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three batches, each sent twice: who comes first with a content stays."""
    every = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("source").alias("tenant_id"), t.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    kept = _table(spark, "documents")
    for i in (0, 0, 1, 1, 2, 2):
        stored.insert_documents(kept, f"batch-{i}", every.filter(F.col("doc_id") % 3 == i))
    return kept.read()


@query("""
SELECT o_custkey AS tenant_id, count(DISTINCT o_orderkey) FILTER (o_orderstatus <> 'F') AS n_documents, count(l_orderkey) FILTER (o_orderstatus <> 'F') AS n_children, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS n_audited
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def delete_stored(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders deleted from the stored tables, children first, with an audit entry
    each; the delete is sent twice."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber").join(orders.select("tenant_id", "doc_id"), "doc_id")
    documents, children, log = _table(spark, "orders"), _table(spark, "lines"), _table(spark, "audit")
    documents.append("all", orders)
    children.append("all", lines)
    gone = orders.filter("o_orderstatus = 'F'").select("tenant_id", "doc_id")
    for _ in range(2):
        stored.delete_documents(documents, [(children, "doc_id")], log, None, "delete", gone)
    counted = lambda df, name: df.groupBy("tenant_id").agg(F.count("*").alias(name))
    each = orders.select("tenant_id").distinct()
    for df, name in ((documents.read(), "n_documents"), (children.read(), "n_children"), (log.read(), "n_audited")):
        each = each.join(counted(df, name), "tenant_id", "left")
    return each.na.fill(0)


@query("""
SELECT label AS tenant_id, vec_id AS at, (max(vec_id) OVER (PARTITION BY label))::DOUBLE AS stored_at FROM embeddings
QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 50""")
def cache_store(spark: SparkSession, d: str) -> DataFrame:
    """A cache stored to in four batches keeps each tenant's fifty newest, renewed by the last store."""
    cache, every = _table(spark, "cache"), table(spark, d, "embeddings").select(F.col("label").alias("tenant_id"), F.col("vec_id").cast("double").alias("at"), F.col("embedding").alias("vector"), F.lit("{}").alias("response"))
    for i in range(4):
        stored.store_answers(cache, f"batch-{i}", every.filter(F.floor(F.col("at")) % 4 == i))
    return stored.living(cache.read(), 0.0).select("tenant_id", F.col("at").cast("long").alias("at"), "stored_at")


@query(f"WITH questions AS ({MANY}) SELECT qid, id, hits::BIGINT AS hits, rank::INTEGER AS rank FROM ({SPARSE})")
def sparse_from_index(spark: SparkSession, d: str) -> DataFrame:
    """Positions by lexemes, from an inverted index that was stored in two batches."""
    return postings.sparse(_index(spark, d, False), many_questions(spark, d))


@query()
def sparse_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The same by stems."""
    return postings.sparse(_index(spark, d, True), many_questions(spark, d), stems=True)


def _index(spark: SparkSession, d: str, stems: bool) -> Versioned:
    index = postings.index(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}/postings")
    for i in range(2):
        postings.add(index, f"batch-{i}", texts(spark, d).filter(F.col("id") % 2 == i), stems)
    return index


@query("SELECT event_id AS msg_id, user_id AS recipient, event_type AS type, props AS payload, epoch(ts)::DOUBLE AS sent FROM events")
def bus_publish(spark: SparkSession, d: str) -> DataFrame:
    """Events published as messages in two batches, one of them twice."""
    bus, every = _table(spark, "bus"), table(spark, d, "events").select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("recipient"), F.col("event_type").alias("type"), F.col("props").alias("payload"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sent"))
    for i in (0, 1, 1):
        stored.publish(bus, f"batch-{i}", every.filter(F.col("msg_id") % 2 == i))
    return bus.read()

"""Ordered state, relational and governance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.operators import governance, state
from lodestar.plans.registry import case, query
from lodestar.sources.tables import Tenant, table


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00'"
PAYLOAD = f"""'{{"created_at":"' || {ISO} || '","event_data":' || coalesce('{{"k":' || (props->>'k') || '}}', 'null') || ',"event_type":"' || event_type || '","id":"' || event_id || '","tenant_id":"' || user_id || '","trace_id":null}}'"""
CHAIN = f"""
WITH RECURSIVE o AS (SELECT user_id, event_id, {PAYLOAD} AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c AS (
  SELECT user_id, event_id, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || payload) AS entry_hash FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.n, c.entry_hash, sha256(c.entry_hash || o.payload) FROM c JOIN o ON o.user_id = c.user_id AND o.n = c.n + 1
)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    payload = t.canonical({
        "id": F.col("event_id").cast("string"), "tenant_id": F.col("user_id").cast("string"), "event_type": F.col("event_type"),
        "event_data": F.from_json("props", "k long"), "trace_id": F.lit(None).cast("string"), "created_at": t.iso(F.col("ts")),
    })
    return events(spark, d).select("user_id", "ts", "event_id", payload.alias("payload"))


def _chained(spark: SparkSession, d: str) -> DataFrame:
    return state.chain(_entries(spark, d), ["user_id"], ["ts", "event_id"], "payload")


@query(CHAIN + "SELECT user_id, event_id, prev_hash, entry_hash FROM c")
def audit_chain_build(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events as a chain of hashes."""
    return _chained(spark, d).select("user_id", "event_id", "prev_hash", "entry_hash")


@query("SELECT user_id, count(*) AS n_entries, NULL::INTEGER AS first_broken FROM events GROUP BY user_id")
def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    return state.verify(_chained(spark, d), "user_id", ["ts", "event_id"], "payload")


@query("""
SELECT user_id, count(*) AS n_entries, min(CASE WHEN event_id % 97 = 5 THEN n - 1 END)::INTEGER AS first_broken
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id""")
def audit_tamper_index(spark: SparkSession, d: str) -> DataFrame:
    """Where a chain breaks once some entries were changed after the fact."""
    changed = F.when(F.col("event_id") % 97 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return state.verify(_chained(spark, d).withColumn("payload", changed), "user_id", ["ts", "event_id"], "payload")


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_query(spark: SparkSession, d: str) -> DataFrame:
    """The newest entries of one type."""
    return events(spark, d).filter("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "user_id")


@query("""
WITH k AS (SELECT user_id, ts::DATE AS day, list(struct_pack(event_id := event_id, value := coalesce(value, 0)) ORDER BY ts, event_id) AS xs FROM events GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, len(xs)::BIGINT AS requests, acc.n AS accepted, round(acc.total, 6) AS used FROM (
  SELECT user_id, day, xs, list_reduce(list_prepend(struct_pack(total := 0::DOUBLE, n := 0::BIGINT), list_transform(xs, lambda x: struct_pack(total := x.value::DOUBLE, n := 1::BIGINT))),
    lambda a, x: CASE WHEN a.total + x.total <= 100 THEN struct_pack(total := a.total + x.total, n := a.n + 1) ELSE a END) AS acc FROM k)""")
def quota_fold(spark: SparkSession, d: str) -> DataFrame:
    """A daily quota: what is refused adds nothing."""
    asked = events(spark, d).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("cost"))
    told = state.quota(asked, 100.0, ["user_id", "day"], ["ts", "event_id"], "cost")
    return told.groupBy("user_id", "day").agg(
        F.count("*").alias("requests"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.round(F.max("used"), 6).alias("used")
    )


@query("""
SELECT user_id, CASE WHEN sum(value) / 5000 >= 0.95 THEN 'throttle' WHEN sum(value) / 5000 >= 0.80 THEN 'warn' ELSE 'ok' END AS label FROM events GROUP BY user_id""")
def quota_state(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.sum("value") / 5000
    return events(spark, d).groupBy("user_id").agg(F.when(ratio >= 0.95, "throttle").when(ratio >= 0.80, "warn").otherwise("ok").alias("label"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 1 AS accepted FROM events")
def hourly_limit(spark: SparkSession, d: str) -> DataFrame:
    return state.hourly_limit(events(spark, d), 1, ["user_id"], "ts", ["event_id"]).select("event_id", "accepted")


@query("""
WITH k AS (SELECT user_id, list(event_id ORDER BY t, event_id) AS ids, list(t ORDER BY t, event_id) AS ats FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t FROM events) GROUP BY user_id),
f AS (SELECT ids, list_reduce(list_prepend(struct_pack(at := 0::DOUBLE, past := []::DOUBLE[], out := []::BOOLEAN[]), list_transform(ats, lambda x: struct_pack(at := x, past := []::DOUBLE[], out := []::BOOLEAN[]))),
  lambda a, x: CASE WHEN len(list_filter(a.past, lambda p: p > x.at - 86400)) < 3
    THEN struct_pack(at := x.at, past := list_append(list_filter(a.past, lambda p: p > x.at - 86400), x.at), out := list_append(a.out, true))
    ELSE struct_pack(at := x.at, past := a.past, out := list_append(a.out, false)) END).out AS told FROM k)
SELECT unnest(ids) AS event_id, unnest(told) AS accepted FROM f""")
def sliding_window_limit(spark: SparkSession, d: str) -> DataFrame:
    """At most three accepted events of a user in any day-long span."""
    timed = events(spark, d).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return state.sliding_window(timed.withColumn("at", F.col("micros") / 1e6), 3, 86_400, ["user_id"], "at", ["event_id"]).select("event_id", "accepted")


@query("""
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'expired' WHEN event_id % 11 = 0 THEN 'invalid_signature' WHEN event_id % 5 >= 3 THEN 'max_delivery_attempts' WHEN event_id % 5 > 0 THEN 'pending' ELSE 'acked' END AS outcome FROM events""")
def dlq_split(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each message."""
    sent = events(spark, d).select(
        "event_id", F.lit(0).alias("sent"), F.when(F.col("event_id") % 13 == 0, 5).otherwise(60).alias("ttl"),
        (F.col("event_id") % 11 != 0).alias("valid"), (F.col("event_id") % 5).alias("failures"), F.lit(30).alias("now"),
    )
    return state.deliver(sent, "now").select("event_id", "outcome")


@query("SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' GROUP BY event_type")
def time_range(spark: SparkSession, d: str) -> DataFrame:
    inside = events(spark, d).filter("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'")
    return inside.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT conv_id, max(turn) AS updated, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY updated DESC, conv_id LIMIT 20 OFFSET 20")
def conversation_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of conversations, latest first."""
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"), F.count("*").alias("n"))
    return listed.orderBy(F.desc("updated"), "conv_id").offset(20).limit(20)


@query("""
SELECT conv_id, turn, question, answer FROM (
  SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
) WHERE role = 'user' AND next_role = 'assistant'""")
def turns(spark: SparkSession, d: str) -> DataFrame:
    """User messages that an assistant message follows at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return both.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query(r"SELECT conv_id, substring(trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')), 1, 60) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def exchange_title(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", t.title(F.col("text")).alias("title"))


@query("SELECT conv_id, count(*) AS stored, count(*) + 2 <= 6 AS has_room FROM conversations GROUP BY conv_id")
def capacity_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("stored"))
    return counted.withColumn("has_room", F.col("stored") + 2 <= 6)


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def tenant_scope(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one tenant's customers."""
    seen = Tenant(7).rows(table(spark, d, "customer"), "c_nationkey").select("c_custkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(seen, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


@query("SELECT 0::BIGINT AS visible_without_user, (SELECT count(*) FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING') AS visible")
def owner_scope_fail_closed(spark: SparkSession, d: str) -> DataFrame:
    """Without a user nothing is seen."""
    customers = table(spark, d, "customer")
    none = Tenant(7).rows(customers, "c_nationkey", "c_mktsegment").agg(F.count("*").alias("visible_without_user"))
    some = Tenant(7, "BUILDING").rows(customers, "c_nationkey", "c_mktsegment").agg(F.count("*").alias("visible"))
    return none.join(some)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    """Children whose parent is not there."""
    there = table(spark, d, "orders").filter("o_orderkey % 50 <> 0").select("o_orderkey")
    children = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return children.join(there, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY l_orderkey")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the children once some parents are deleted."""
    deleted = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    kept = table(spark, d, "lineitem").select("l_orderkey", "l_quantity").join(deleted, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


QUESTIONS = "(VALUES " + ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}', {w})" for i, (q, w) in enumerate(governance.VENDOR_QUESTIONS)) + ") AS q(i, question, weight)"


@query(f"""
SELECT s_suppkey, raw::INTEGER AS raw, round(raw * 100.0::DOUBLE / 107)::INTEGER AS normalised,
       CASE WHEN round(raw * 100.0::DOUBLE / 107) >= 80 THEN 'low_risk' WHEN round(raw * 100.0::DOUBLE / 107) >= 50 THEN 'medium_risk' ELSE 'high_risk' END AS tier, flagged
FROM (SELECT s_suppkey, sum(CASE WHEN good THEN weight ELSE 0 END) AS raw, coalesce(string_agg(question, '|' ORDER BY i) FILTER (NOT good), '') AS flagged
      FROM (SELECT s_suppkey, i, question, weight, ((s_suppkey * 31 + i * 17) % 5 < 3) <> (i = 7) AS good FROM supplier, {QUESTIONS}) GROUP BY s_suppkey)""")
def vendor_score(spark: SparkSession, d: str) -> DataFrame:
    answers = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (F.col("s_suppkey") * 31 + i * 17) % 5 < 3)
    scored = table(spark, d, "supplier").select("s_suppkey", governance.vendor_score(answers).alias("s")).select("s_suppkey", "s.*")
    return scored.withColumn("flagged", F.array_join("flagged", "|"))


@case("SELECT 18::BIGINT AS identifiers, 10::BIGINT AS covered")
def hipaa_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(governance.IDENTIFIERS), "identifier string, entity string")
    return rows.agg(F.count("*").alias("identifiers"), F.count("entity").alias("covered"))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return governance.nearest_rank(events(spark, d), "event_type", "value")


PSI = """
WITH x AS (SELECT vec_id % 2 = 0 AS old, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
b AS (SELECT dim, least(greatest(floor((v::DOUBLE + 1) / 2 * 10), 0), 9)::INTEGER AS bin, count(*) FILTER (old) AS a, count(*) FILTER (NOT old) AS b FROM x GROUP BY 1, 2),
s AS (SELECT count(*) FILTER (vec_id % 2 = 0) AS na, count(*) FILTER (vec_id % 2 = 1) AS nb FROM embeddings),
p AS (SELECT dim, sum((greatest(b / nb, 1e-4) - greatest(a / na, 1e-4)) * ln(greatest(b / nb, 1e-4) / greatest(a / na, 1e-4))) AS psi FROM b, s GROUP BY dim)
"""


def _drift(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return governance.drift(vectors.filter("vec_id % 2 = 0").select("embedding"), vectors.filter("vec_id % 2 = 1").select("embedding"))


@query(PSI + "SELECT dim::INTEGER AS dim, round(psi, 8) AS psi FROM p")
def drift_psi_per_dim(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).select("dim", F.round("psi", 8).alias("psi"))


@query(PSI + "SELECT round(avg((psi >= 0.05)::INTEGER), 6) AS share, avg((psi >= 0.05)::INTEGER) > 0.2 AS alert FROM p")
def drift_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of dimensions that moved, and whether that raises an alert."""
    share = F.avg((F.col("psi") >= 0.05).cast("int"))
    return _drift(spark, d).agg(F.round(share, 6).alias("share"), (share > 0.2).alias("alert"))


CASES = "(VALUES (1, 'faithfulness', 0.95, 0.90), (2, 'faithfulness', 0.85, 0.90), (3, 'answer_relevancy', 0.86, 0.85), (4, 'context_precision', 0.70, 0.80), (5, 'context_precision', 0.89996, 0.80)) AS t(id, metric, score, floor)"


@case(f"SELECT metric, round(avg(score::DOUBLE), 4) AS mean, round(avg(score::DOUBLE), 4) >= max(floor)::DOUBLE AS passes FROM {CASES} GROUP BY metric")
def gate_check(spark: SparkSession, d: str) -> DataFrame:
    mean = F.round(F.avg(F.col("score").cast("double")), 4)
    return spark.sql(f"SELECT * FROM {CASES}").groupBy("metric").agg(mean.alias("mean"), (mean >= F.max("floor").cast("double")).alias("passes"))


CALLS = "(VALUES ('research', 'query_kb'), ('research', 'run_code'), ('coder', 'run_code'), ('ghost', 'query_kb')) AS c(agent, tool)"
ALLOWED = "(VALUES ('research', 'query_kb'), ('coder', 'run_code'), ('coder', 'query_kb')) AS a(agent, tool)"


@case(f"SELECT c.agent, c.tool, a.agent IS NOT NULL AS allowed FROM {CALLS} LEFT JOIN {ALLOWED} ON c.agent = a.agent AND c.tool = a.tool")
def tool_allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Denied unless listed."""
    listed = spark.sql(f"SELECT agent, tool, true AS listed FROM {ALLOWED}")
    return spark.sql(f"SELECT * FROM {CALLS}").join(listed, ["agent", "tool"], "left").select("agent", "tool", F.coalesce("listed", F.lit(False)).alias("allowed"))

"""Lookups, uploads, messages, limiters and rules of a retrieval service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.operators import governance, state
from lodestar.plans.documents import MARKED, _marked
from lodestar.plans.operations import CHAIN, _chained, events
from lodestar.plans.registry import ORACLE_SQL, case, query
from lodestar.sources.tables import Tenant, table

IDS = tuple(range(1, 400, 3))


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_custkey IN {IDS}")
def tenant_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows by key; another tenant's rows look as if they were missing."""
    return Tenant(7).rows(table(spark, d, "customer"), "c_nationkey").filter(F.col("c_custkey").isin(*IDS)).select("c_custkey", "c_name")


@query("""
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n_chunks,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) <= 20 AS accepted FROM documents""")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each document, and whether they are few enough to store."""
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n_chunks"), (n <= 20).alias("accepted"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 1000")
def messages_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand messages of every conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", place.alias("place")).filter("place <= 1000").drop("place")


@query(CHAIN + "SELECT user_id, arg_max(entry_hash, n) AS latest FROM c GROUP BY user_id")
def audit_latest_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash that each user's next entry must cover."""
    return _chained(spark, d).groupBy("user_id").agg(F.max_by("entry_hash", F.struct("ts", "event_id")).alias("latest"))


@query("""
SELECT event_id, e.user_id FROM events e LEFT JOIN (SELECT user_id, max(ts) AS last FROM events WHERE event_id % 7 = 0 GROUP BY user_id) r ON e.user_id = r.user_id
WHERE event_type = 'click' AND (last IS NULL OR ts > last)""")
def review_pending(spark: SparkSession, d: str) -> DataFrame:
    """What nobody has resolved since it was flagged. Resolutions aggregate to
    one time a user before they are joined."""
    resolved = events(spark, d).filter("event_id % 7 = 0").groupBy("user_id").agg(F.max("ts").alias("last"))
    flagged = events(spark, d).filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return flagged.join(resolved, "user_id", "left").filter("last IS NULL OR ts > last").select("event_id", "user_id")


@query("""
SELECT event_id, lpad(lower(to_hex(event_id)), 32, '0') AS trace_id, floor(epoch(ts) / 3600)::BIGINT AS hour_key, strftime(ts, '%Y-%m-%d') AS day_key,
  greatest(1, ceil(value / 10))::BIGINT AS retry_after, round_even(event_id / 2.0::DOUBLE, 0) AS half_even FROM events""")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    """Trace id, hour and day keys, whole seconds to wait, and rounding to even."""
    return events(spark, d).select(
        "event_id", F.lpad(F.lower(F.hex("event_id")), 32, "0").alias("trace_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour_key"),
        F.date_format("ts", "yyyy-MM-dd").alias("day_key"), F.greatest(F.lit(1), F.ceil(F.col("value") / 10)).cast("long").alias("retry_after"),
        F.bround(F.col("event_id") / 2.0, 0).alias("half_even"),
    )


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || coalesce(props, '{}') || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as server-sent frames."""
    return events(spark, d).select("event_id", F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), F.coalesce("props", F.lit("{}")), F.lit("\n\n")).alias("frame"))


@query(rf"""
SELECT conv_id, turn, array_to_string(string_split_regex(answer, '\[[0-9]+\]'), '|') AS parts, array_to_string(regexp_extract_all(answer, '\[([0-9]+)\]', 1), '|') AS cited FROM ({MARKED})""")
def citation_split(spark: SparkSession, d: str) -> DataFrame:
    """Text between citations, and the citations."""
    parts = F.array_join(F.split("answer", r"\[[0-9]+\]", -1), "|")
    return _marked(spark, d).select("conv_id", "turn", parts.alias("parts"), F.array_join(F.regexp_extract_all("answer", F.lit(t.CITATION), F.lit(1)), "|").alias("cited"))


@query(f"SELECT page_id, regexp_matches('see ' || url || ')', '{t.URL}') AS leaks, regexp_extract('see ' || url || ')', '{t.URL}') AS target FROM pages")
def url_exfil(spark: SparkSession, d: str) -> DataFrame:
    """Answers that carry a link out."""
    answer = F.concat(F.lit("see "), "url", F.lit(")"))
    return table(spark, d, "pages").select("page_id", answer.rlike(t.URL).alias("leaks"), F.regexp_extract(answer, t.URL, 0).alias("target"))


@query(f"SELECT event_type, outcome, count(*) AS n FROM events JOIN ({ORACLE_SQL['dlq_split']}) USING (event_id) GROUP BY ALL")
def outcome_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Messages by type and outcome."""
    sent = events(spark, d).select(
        "event_type", F.lit(0).alias("sent"), F.when(F.col("event_id") % 13 == 0, 5).otherwise(60).alias("ttl"),
        (F.col("event_id") % 11 != 0).alias("valid"), (F.col("event_id") % 5).alias("failures"), F.lit(30).alias("now"),
    )
    return state.deliver(sent, "now").groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


@query("SELECT event_id // 4 AS msg_id, count(*) AS attempts, count(*) >= 3 AS dead FROM events WHERE event_type <> 'click' GROUP BY 1")
def delivery_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of each message; three without success end in the dead letters."""
    tried = events(spark, d).filter("event_type <> 'click'").groupBy(F.expr("event_id div 4").alias("msg_id"))
    return tried.agg(F.count("*").alias("attempts"), (F.count("*") >= 3).alias("dead"))


@query("""
SELECT role, CASE WHEN role = 'user' AND length(trim(coalesce(text, ''))) NOT BETWEEN 1 AND 2000 THEN 'question_bounds'
  WHEN role = 'assistant' AND length(coalesce(text, '')) > 50000 THEN 'answer_too_long' ELSE 'accepted' END AS verdict, count(*) AS n FROM conversations GROUP BY ALL""")
def exchange_bounds(spark: SparkSession, d: str) -> DataFrame:
    said = F.coalesce("text", F.lit(""))
    verdict = F.when((F.col("role") == "user") & ~F.length(F.trim(said)).between(1, 2000), "question_bounds").when((F.col("role") == "assistant") & (F.length(said) > 50_000), "answer_too_long").otherwise("accepted")
    return table(spark, d, "conversations").groupBy("role", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS dim_{i}" for i in range(64)) + " FROM embeddings WHERE vec_id >= 100 AND vec_id < 200")
def drift_extract(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a half-open range, one column a dimension."""
    some = table(spark, d, "embeddings").filter("vec_id >= 100 AND vec_id < 200")
    return some.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"dim_{i}") for i in range(64)))


CLAIMS = "(VALUES (1, 'team-2;team-1;team-2'), (2, 'team-1;no team'), (3, 'team-7'), (4, '')) AS t(id, claims)"


@case(f"""
SELECT id, CASE WHEN len(list_filter(string_split(claims, ';'), lambda x: NOT regexp_matches(x, '^team-[0-9]+$'))) = 0 THEN array_to_string(list_sort(list_distinct(string_split(claims, ';'))), ',') END AS tenants FROM {CLAIMS}""")
def tenant_claims(spark: SparkSession, d: str) -> DataFrame:
    """Tenants of a token; one malformed claim fails all of it."""
    claims = F.split("claims", ";")
    whole = F.forall(claims, lambda x: x.rlike("^team-[0-9]+$"))
    return spark.sql(f"SELECT * FROM {CLAIMS}").select("id", F.when(whole, F.array_join(F.array_sort(F.array_distinct(claims)), ",")).alias("tenants"))


UPLOADS = "(VALUES (1, 'a.md', '# Title'), (2, 'b.TXT', '  '), (3, 'c.pdf', '%PDF-1.7 x'), (4, 'd.txt', '%PDF-1.7 x'), (5, 'e.pdf', 'plain'), (6, 'f.exe', 'MZ')) AS t(id, name, body)"


@case(f"""
SELECT id, CASE WHEN regexp_matches(name, '(?i)\\.(txt|md)$') THEN CASE WHEN starts_with(body, '%PDF-') THEN 'mismatch' WHEN trim(body) = '' THEN 'blank' ELSE 'text' END
  WHEN regexp_matches(name, '(?i)\\.pdf$') THEN CASE WHEN starts_with(body, '%PDF-') THEN 'pdf' ELSE 'mismatch' END ELSE 'unsupported' END AS kind FROM {UPLOADS}""")
def upload_classify(spark: SparkSession, d: str) -> DataFrame:
    """The name picks a family, the content must agree."""
    pdf, name = F.col("body").startswith("%PDF-"), F.col("name")
    as_text = F.when(pdf, "mismatch").when(F.trim("body") == "", "blank").otherwise("text")
    kind = F.when(name.rlike(r"(?i)\.(txt|md)$"), as_text).when(name.rlike(r"(?i)\.pdf$"), F.when(pdf, "pdf").otherwise("mismatch")).otherwise("unsupported")
    return spark.sql(f"SELECT * FROM {UPLOADS}").select("id", kind.alias("kind"))


SYSTEMS = (
    "social scoring of citizens", "Ranks candidates for hiring", "a chatbot for parcel tracking", "spam filter", "credit scoring with a chatbot", "subliminal manipulation in hiring",
)
DESCRIBED = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(SYSTEMS)) + ") AS t(id, description)"


@case(f"SELECT id, CASE {' '.join(f'''WHEN regexp_matches(description, '{p}') THEN '{tier}' ''' for tier, p in governance.RISK_TIERS)} ELSE 'minimal' END AS tier FROM {DESCRIBED}")
def risk_tier(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {DESCRIBED}").select("id", governance.risk_tier(F.col("description")).alias("tier"))


@case(f"SELECT id, CASE WHEN regexp_matches(description, '{governance.CONSEQUENTIAL}') THEN '{','.join(governance.OBLIGATIONS)}' ELSE '' END AS obligations FROM {DESCRIBED}")
def decision_obligations(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {DESCRIBED}").select("id", F.array_join(governance.obligations(F.col("description")), ",").alias("obligations"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


def folded(key: str, rows: dict[str, str], begin: dict[str, str], step: dict[str, str], source: str) -> str:
    """SQL (id, o) that folds each key's rows (id, clock, ...) in order: rows are the fields of x, begin those of
    the state a, step what they become after x; the list `out` has an element for each row."""
    fields = lambda d: ", ".join(f"{k} := {v}" for k, v in d.items())
    return f"""
SELECT unnest(ids) AS id, unnest(out) AS o FROM (
  SELECT ids, list_reduce(list_prepend(struct_pack({fields(dict.fromkeys(rows, 'NULL'))}, {fields(begin)}), list_transform(xs, lambda x: struct_pack({fields({r: f'x.{r}' for r in rows})}, {fields(begin)}))),
    lambda a, x: struct_pack({fields({r: f'x.{r}' for r in rows})}, {fields(step)})).out AS out
  FROM (SELECT {key}, list(id ORDER BY clock, id) AS ids, list(struct_pack({fields(rows)}) ORDER BY clock, id) AS xs FROM ({source}) GROUP BY {key}))"""


TIMED = "SELECT event_id AS id, user_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS clock FROM events"
START = "greatest(x.clock, CASE WHEN len(a.starts) >= 3 THEN a.starts[-3] + 86400 END, a.starts[-1])"
RESERVED = folded(
    "user_id", {"clock": "clock"}, {"starts": "[]::DOUBLE[]", "out": "[]::DOUBLE[]"},
    {"starts": f"CASE WHEN {START} - x.clock > 43200 THEN a.starts ELSE list_append(a.starts, {START}) END", "out": f"list_append(a.out, CASE WHEN {START} - x.clock <= 43200 THEN {START} END)"},
    TIMED,
)


@query(f"SELECT id AS event_id, o IS NOT NULL AS accepted, o AS start FROM ({RESERVED})")
def embed_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Starts of a user's calls: three in any day-long span, at most half a day's wait."""
    return state.reserve(_timed(spark, d), 3, 86_400, 43_200, ["user_id"], "at", ["event_id"]).select("event_id", "accepted", "start")


LIVE = "list_filter(a.until, lambda u: u.e > x.clock)"
OTHER = "list_filter(a.until, lambda u: u.e > x.clock AND u.h <> x.h)"
GRANTED = f"(len({OTHER}) < len({LIVE}) OR (NOT x.r AND len({LIVE}) < 2))"
UNTIL = f"CASE WHEN x.r THEN {OTHER} WHEN {GRANTED} THEN list_append({OTHER}, struct_pack(h := x.h, e := x.clock + 172800)) ELSE {LIVE} END"
SLOTS = folded(
    "user_id", {"clock": "clock", "h": "id % 3", "r": "event_type = 'click'"}, {"until": "[]::STRUCT(h BIGINT, e DOUBLE)[]", "out": "[]::STRUCT(g BOOLEAN, n BIGINT)[]"},
    {"until": UNTIL, "out": f"list_append(a.out, struct_pack(g := {GRANTED}, n := len({UNTIL})))"}, TIMED,
)


@query(f"SELECT id AS event_id, o.g AS granted, o.n::INTEGER AS held FROM ({SLOTS})")
def slots(spark: SparkSession, d: str) -> DataFrame:
    """Two at once a user; clicks release what the same holder took."""
    asked = _timed(spark, d).withColumns({"holder": F.col("event_id") % 3, "release": F.col("event_type") == "click"})
    return state.slots(asked, 2, 172_800, ["user_id"], "at", ["event_id"]).select("event_id", "granted", "held")


AGAIN = "(len(a.pending) > 0 AND x.clock - a.pending[1].t >= 172800)"
FIRST = "a.pending[1]"
DELIVERED = folded(
    "user_id",
    {"clock": "clock", "k": "CASE WHEN event_type = 'click' THEN 'publish' WHEN id % 7 = 0 THEN 'ack' ELSE 'call' END", "m": "CASE WHEN event_type <> 'click' AND id % 7 = 0 THEN id - 7 ELSE id END"},
    {"fresh": "[]::BIGINT[]", "pending": "[]::STRUCT(m BIGINT, t DOUBLE, n BIGINT)[]", "out": "[]::STRUCT(c BOOLEAN, m BIGINT, n BIGINT, d BOOLEAN)[]"},
    {
        "fresh": f"CASE WHEN x.k = 'publish' THEN list_append(a.fresh, x.m) WHEN x.k = 'call' AND NOT {AGAIN} THEN a.fresh[2:] ELSE a.fresh END",
        "pending": f"""CASE WHEN x.k = 'ack' THEN list_filter(a.pending, lambda p: p.m <> x.m) WHEN x.k = 'publish' THEN a.pending
      WHEN {AGAIN} THEN CASE WHEN {FIRST}.n >= 3 THEN a.pending[2:] ELSE list_append(a.pending[2:], struct_pack(m := {FIRST}.m, t := x.clock, n := {FIRST}.n + 1)) END
      WHEN len(a.fresh) > 0 THEN list_append(a.pending, struct_pack(m := a.fresh[1], t := x.clock, n := 1::BIGINT)) ELSE a.pending END""",
        "out": f"""list_append(a.out, CASE WHEN x.k = 'call' AND {AGAIN} THEN struct_pack(c := true, m := {FIRST}.m, n := least({FIRST}.n + 1, 3), d := {FIRST}.n >= 3)
      WHEN x.k = 'call' AND len(a.fresh) > 0 THEN struct_pack(c := true, m := a.fresh[1], n := 1::BIGINT, d := false) ELSE struct_pack(c := x.k = 'call', m := NULL::BIGINT, n := NULL::BIGINT, d := false) END)""",
    }, TIMED,
)


@query(f"SELECT id AS event_id, o.m AS given, o.n::INTEGER AS tries, o.d AS dead FROM ({DELIVERED}) WHERE o.c")
def redelivery(spark: SparkSession, d: str) -> DataFrame:
    """What each call of a user gets: unacknowledged messages first, once they have
    waited two days; after three tries they are dead letters."""
    kind = F.when(F.col("event_type") == "click", "publish").when(F.col("event_id") % 7 == 0, "ack").otherwise("call")
    asked = _timed(spark, d).select("event_id", "user_id", "at", kind.alias("kind"), F.when(kind == "ack", F.col("event_id") - 7).otherwise(F.col("event_id")).alias("msg"))
    return state.consumed(asked, ["user_id"], "at", ["event_id"], 172_800.0).filter("kind = 'call'").select("event_id", "given", "tries", "dead")

"""From a question to its stored answer, and the rules around it: what enters, what
is cited, flagged, logged, appended, resolved and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import personal
from lodestar.functions import text as t
from lodestar.operators import governance, ingest
from lodestar.plans import spans
from lodestar.plans.documents import CHUNKS, MARKED, VALID, _marked, documents
from lodestar.plans.operations import ISO, events
from lodestar.plans.registry import case, query
from lodestar.sources.tables import table

JUDGED = f"""SELECT conv_id, turn, answer, total, {VALID} AS valid, CASE conv_id % 3 WHEN 0 THEN ' relevant ' WHEN 1 THEN 'RELEVANT' ELSE 'not relevant' END AS verdict FROM ({MARKED})"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("conv_id") % 3 == 0, " relevant ").when(F.col("conv_id") % 3 == 1, "RELEVANT").otherwise("not relevant")
    valid = F.filter(t.citations(F.col("answer")), lambda x: x.between(1, F.col("total")))
    return _marked(spark, d).select("conv_id", "turn", "answer", "total", valid.alias("valid"), said.alias("verdict"))


@query(f"""
SELECT conv_id, turn, upper(trim(verdict)) = 'RELEVANT' AND total > 0 AS relevant, length(answer) // 4 AS tokens, len(valid) AS n_citations,
  array_to_string(list_transform(valid, lambda x: conv_id || ':' || x), ',') AS cited, total - len(valid) AS uncited,
  CASE WHEN len(valid) = 0 THEN 'no_citations' WHEN len(valid) / total < 0.5 THEN 'low_grounding' ELSE '' END AS flag_reasons, len(valid) = 0 OR len(valid) / total < 0.5 AS flagged
FROM ({JUDGED})""")
def answer_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Each answer with its citations, what was retrieved but not cited, tokens and flags."""
    reasons = t.grounding(F.size("valid"), F.col("total"))
    cited = F.transform("valid", lambda x: F.struct(F.concat_ws(":", "conv_id", x).alias("chunk_id"), F.col("conv_id").alias("document_id")))
    made = _judged(spark, d).withColumns({"reasons": reasons, "citations": cited})
    return made.select(
        "conv_id", "turn", ((F.upper(F.trim("verdict")) == "RELEVANT") & (F.col("total") > 0)).alias("relevant"), F.floor(F.length("answer") / 4).alias("tokens"),
        F.size("citations").cast("long").alias("n_citations"), F.array_join("citations.chunk_id", ",").alias("cited"), (F.col("total") - F.size("valid")).alias("uncited"),
        F.array_join("reasons", ",").alias("flag_reasons"), (F.size("reasons") > 0).alias("flagged"),
    )


@query(f"""
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'reviewed' ELSE 'pending' END AS status, CASE WHEN conv_id % 4 = 0 THEN 'checked' END AS note
FROM ({JUDGED}) WHERE len(valid) = 0 OR len(valid) / total < 0.5""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Answers with any reason wait for a review; some are resolved, with a note."""
    waiting = _judged(spark, d).filter(F.size(t.grounding(F.size("valid"), F.col("total"))) > 0).select("conv_id", "turn")
    resolved = F.col("conv_id") % 4 == 0
    return waiting.select("conv_id", "turn", F.when(resolved, "reviewed").otherwise("pending").alias("status"), F.when(resolved, F.lit("checked")).alias("note"))


@query("SELECT conv_id, turn, sha256(text) AS question_hash, length(text) AS chars FROM conversations WHERE role = 'user'")
def query_log(spark: SparkSession, d: str) -> DataFrame:
    """Every question is logged, whatever becomes of it."""
    asked = table(spark, d, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.sha2("text", 256).alias("question_hash"), F.length("text").cast("long").alias("chars"))


@query("""
SELECT user_id, coalesce(max(CASE WHEN value > 50 THEN round(value / 1000, 6) END), 0.0)::DOUBLE AS score FROM events GROUP BY user_id""")
def context_score(spark: SparkSession, d: str) -> DataFrame:
    """The highest score of what was retrieved; none counts as 0."""
    score = F.max(F.when(F.col("value") > 50, F.round(F.col("value") / 1000, 6)))
    return events(spark, d).groupBy("user_id").agg(F.coalesce(score, F.lit(0.0)).alias("score"))


@query(r"""
WITH w AS (SELECT doc_id, ts, least(len(ts), i * 446 + 510) AS last, i * 446 AS first FROM (SELECT doc_id, regexp_extract_all(text, '\w+') AS ts FROM documents), range(0, 64) AS g(i)
  WHERE len(ts) > 0 AND i < CASE WHEN len(ts) <= 510 THEN 1 ELSE ceil((len(ts) - 510) / 446.0) + 1 END)
SELECT doc_id, count(*) AS windows, max(len(list_filter(ts[first + 1:last], lambda x: ends_with(x, 'e'))) / (last - first)::DOUBLE) AS score FROM w GROUP BY doc_id""")
def window_scores(spark: SparkSession, d: str) -> DataFrame:
    """A text's score is the highest of its windows'; here the share of words that end in e."""
    words = documents(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)).alias("ts"))
    one = words.select("doc_id", "ts", F.explode(t.windows(F.size("ts"))).alias("w")).select("doc_id", F.slice("ts", F.col("w.first") + 1, F.col("w.last") - F.col("w.first")).alias("ts"))
    share = F.size(F.filter("ts", lambda x: x.endswith("e"))) / F.size("ts")
    return one.groupBy("doc_id").agg(F.count("*").alias("windows"), F.max(share).alias("score"))


OPEN = "SELECT conv_id, count(*) AS stored, CASE WHEN conv_id % 2 = 0 THEN 'New conversation' ELSE 'Named ' || conv_id END AS title, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id) AS now FROM conversations GROUP BY conv_id"
ASKED = "'  What is   next in ' || conv_id || '?'"


@query(rf"""
SELECT conv_id, role, CASE role WHEN 'user' THEN {ASKED} ELSE 'It is known.' END AS text, CASE role WHEN 'user' THEN now ELSE now + INTERVAL 1 MILLISECOND END AS created_at,
  CASE WHEN title = 'New conversation' THEN substring(trim(regexp_replace({ASKED}, '\s+', ' ', 'g')), 1, 60) ELSE title END AS title, now + INTERVAL 1 MILLISECOND AS updated_at
FROM ({OPEN}), (VALUES ('user'), ('assistant')) AS r(role) WHERE stored + 2 <= 6""")
def exchange_append(spark: SparkSession, d: str) -> DataFrame:
    """A question and its answer, a millisecond apart, go to each conversation that
    has room; the first question names a conversation that has no name yet."""
    found = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("stored")).filter("stored + 2 <= 6")
    asked = F.concat(F.lit("  What is   next in "), "conv_id", F.lit("?"))
    named = found.select("conv_id", F.when(F.col("conv_id") % 2 == 0, "New conversation").otherwise(F.concat(F.lit("Named "), "conv_id")).alias("title"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, conv_id)").alias("now"), asked.alias("question"))
    later = F.col("now") + F.expr("INTERVAL '0.001' SECOND")
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), F.col("now").alias("created_at")),
        F.struct(F.lit("assistant").alias("role"), F.lit("It is known.").alias("text"), later.alias("created_at")),
    )
    title = F.when(F.col("title") == "New conversation", t.title(F.col("question"))).otherwise(F.col("title"))
    return named.select("conv_id", F.explode(pair).alias("m"), title.alias("title"), later.alias("updated_at")).select("conv_id", "m.*", "title", "updated_at")


@query("SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations FROM conversations WHERE conv_id % 5 <> 0 GROUP BY role")
def conversation_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left once some conversations are deleted: their messages go first."""
    said = table(spark, d, "conversations")
    gone = said.filter("conv_id % 5 = 0").select("conv_id").distinct()
    return said.join(gone, "conv_id", "left_anti").groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("conversations"))


LIMITS = "(VALUES ('/ingest', 4000), ('/query', 1000), ('/search', 1000)) AS l(path, most)"
SENT = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/ingest' WHEN 1 THEN '/query' WHEN 2 THEN '/search' ELSE '/documents' END AS path, CASE WHEN page_id % 3 > 0 THEN strlen(html) // (page_id % 3) END AS declared, strlen(html) AS counted FROM pages"


@query(f"""
SELECT page_id, s.path, CASE WHEN most IS NULL THEN 'no_body' WHEN declared > most THEN 'declared_too_large' WHEN counted > most THEN 'too_large' ELSE 'ok' END AS verdict
FROM ({SENT}) s LEFT JOIN {LIMITS} USING (path)""")
def body_limits(spark: SparkSession, d: str) -> DataFrame:
    """The declared length is looked at first, then what really comes."""
    path = F.element_at(F.array(*map(F.lit, ("/ingest", "/query", "/search", "/documents"))), (F.col("page_id") % 4 + 1).cast("int"))
    counted = F.octet_length("html")
    declared = F.when(F.col("page_id") % 3 > 0, F.floor(counted / (F.col("page_id") % 3)))
    sent = table(spark, d, "pages").select("page_id", path.alias("path"), declared.alias("declared"), counted.alias("counted"))
    limits = F.broadcast(spark.sql(f"SELECT * FROM {LIMITS}"))  # three rows
    verdict = F.when(F.col("most").isNull(), "no_body").when(F.col("declared") > F.col("most"), "declared_too_large").when(F.col("counted") > F.col("most"), "too_large").otherwise("ok")
    return sent.join(limits, "path", "left").select("page_id", "path", verdict.alias("verdict"))


# Paths whose bodies are looked at, and the field that is.
INSPECTED = (("/query", "question"), ("/query/stream", "question"), ("/ingest", "text"))
CALLED = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/query' WHEN 1 THEN '/query/' WHEN 2 THEN '/ingest' WHEN 3 THEN '/query/stream' ELSE '/health' END AS path FROM events"


@query(f"SELECT path, count(*) AS n FROM ({CALLED}) WHERE path IN ({', '.join(repr(p) for p, _ in INSPECTED)}) GROUP BY path")
def inspected_paths(spark: SparkSession, d: str) -> DataFrame:
    """Calls that the firewall inspects: paths must match exactly."""
    path = F.element_at(F.array(*map(F.lit, ("/query", "/query/", "/ingest", "/query/stream", "/health"))), (F.col("event_id") % 5 + 1).cast("int"))
    known = F.broadcast(spark.createDataFrame(list(INSPECTED), "path string, field string"))
    return events(spark, d).select(path.alias("path")).join(known, "path", "left_semi").groupBy("path").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, c_custkey % 7 = 0 AS is_admin, c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0 AS is_member
FROM customer""")
def role_membership(spark: SparkSession, d: str) -> DataFrame:
    """Roles and groups of a user are lists; access needs a certain one in them."""
    roles = F.array_compact(F.array(F.lit("user"), F.when(F.col("c_custkey") % 7 == 0, "platform-admin")))
    tenants = F.array_compact(F.array(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "building")))
    return table(spark, d, "customer").select("c_custkey", F.array_contains(roles, "platform-admin").alias("is_admin"), F.array_contains(tenants, "building").alias("is_member"))


@query("""
SELECT 'many_requests' AS title, event_type || ' ' || strftime(day, '%Y-%m-%d') || ': ' || n AS details, CASE WHEN n > 80 THEN 'webhook' ELSE 'log' END AS channel
FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 60""")
def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Rows for the alerts table: days with too many requests of a type."""
    counted = events(spark, d).groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).filter("n > 60")
    return counted.select(F.lit("many_requests").alias("title"), F.concat("event_type", F.lit(" "), "day", F.lit(": "), "n").alias("details"), F.when(F.col("n") > 80, "webhook").otherwise("log").alias("channel"))


COVERED = "(VALUES " + ", ".join(f"({i}, '{x}', {repr(e) if e else 'NULL'})" for i, (x, e) in enumerate(governance.IDENTIFIERS)) + ") AS t(i, identifier, entity)"


@case(f"""
SELECT '# Safe harbour' || chr(10) || chr(10) || string_agg('- ' || identifier || ': ' || coalesce(entity, 'not covered'), chr(10) ORDER BY i) || chr(10) AS markdown FROM {COVERED}""")
def hipaa_report(spark: SparkSession, d: str) -> DataFrame:
    """The coverage of identifiers as Markdown."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(governance.IDENTIFIERS)], "i int, identifier string, entity string")
    line = F.concat(F.lit("- "), "identifier", F.lit(": "), F.coalesce("entity", F.lit("not covered")))
    lines = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))
    return rows.agg(F.concat(F.lit("# Safe harbour\n\n"), F.array_join(F.transform(lines, lambda x: x.line), "\n"), F.lit("\n")).alias("markdown"))


@query("""
SELECT event_id, place::INTEGER AS place, CASE place WHEN 0 THEN event_type ELSE 'message' END AS event, CASE place WHEN 0 THEN coalesce(props, '{}') ELSE 'a' || chr(10) || event_id END AS data
FROM events, range(0, 2) AS g(place)""")
def sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Server-sent text as events again: any line ends, comments, several data lines."""
    sent = F.concat(F.lit(": hello\r\nevent: "), "event_type", F.lit("\rdata: "), F.coalesce("props", F.lit("{}")), F.lit("\r\n\r\ndata: a\ndata:"), F.col("event_id").cast("string"), F.lit("\n\n"))
    return events(spark, d).select("event_id", F.posexplode(t.server_events(sent)).alias("place", "e")).select("event_id", "place", "e.event", "e.data")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'key' || c_custkey WHEN 2 THEN NULL ELSE NULL END AS token FROM customer""")
def bearer_tokens(spark: SparkSession, d: str) -> DataFrame:
    kinds = [F.lit("Bearer   "), F.concat(F.lit("Bearer  key"), "c_custkey", F.lit(" ")), F.concat(F.lit("Basic key"), "c_custkey"), F.lit(None).cast("string")]
    header = F.element_at(F.array(*kinds), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", t.bearer(header).alias("token"))


@query("SELECT p_partkey, round(least(200 / 72.0::DOUBLE, sqrt(250000.0::DOUBLE / greatest(p_size * 40.0::DOUBLE * p_size * 30, 1))), 9) AS scale FROM part")
def page_scale(spark: SparkSession, d: str) -> DataFrame:
    """How far a page may be enlarged: by resolution, and by pixels in all."""
    area = F.greatest(F.col("p_size") * 40.0 * F.col("p_size") * 30, F.lit(1.0))
    return table(spark, d, "part").select("p_partkey", F.round(F.least(F.lit(200 / 72.0), F.sqrt(250_000.0 / area)), 9).alias("scale"))


@query("SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER - 1 AS chunk_index, 'chunk ' || vec_id AS text, vec_id, embedding[1]::DOUBLE AS first FROM embeddings")
def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and vectors of a document paired by place; different lengths are an error."""
    both = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    lists = table(spark, d, "embeddings").groupBy("label").agg(both.alias("b")).select("label", F.transform("b", lambda x: F.concat(F.lit("chunk "), x.vec_id)).alias("texts"), F.col("b").alias("vectors"))
    paired = lists.select("label", F.posexplode(ingest.zipped(F.col("texts"), F.col("vectors"))).alias("chunk_index", "z"))
    return paired.select("label", "chunk_index", F.col("z.left").alias("text"), F.col("z.right.vec_id").alias("vec_id"), F.get("z.right.embedding", F.lit(0)).cast("double").alias("first"))


KEY = b"a key that both ends share"
PADS = {x: bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)}
BODY = f"""'{{"msg_id":"' || event_id || '","payload":' || coalesce('{{"k":' || (props->>'k') || '}}', 'null') || ',"sent":"' || {ISO} || '","type":"' || event_type || '"}}'"""


@query(f"""
SELECT event_id, sha256(from_hex('{PADS[0x5C]}') || from_hex(sha256(from_hex('{PADS[0x36]}') || encode({BODY})))) AS digest, event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AS valid FROM events""")
def signature_check(spark: SparkSession, d: str) -> DataFrame:
    """Messages signed over all but the signature; changed, malformed and missing ones are not valid."""
    body = t.canonical({"msg_id": F.col("event_id").cast("string"), "type": F.col("event_type"), "payload": F.from_json("props", "k long"), "sent": t.iso(F.col("ts"))})
    sent = events(spark, d).select("event_id", body.alias("body")).withColumn("digest", t.hmac_sha256(KEY, F.col("body")))
    signature = F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 13 == 0, "not base64 ###").otherwise(F.base64(F.unhex("digest")))
    got = F.when(F.col("event_id") % 17 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body"))
    return sent.select("event_id", "digest", t.signed(signature, KEY, got).alias("valid"))


# The stages of an answer, in their order.
STAGES = ("cache_lookup", "retrieval", "grading", "generation", "output_checks")


@query(f"SELECT conv_id, turn, place::INTEGER AS place, {list(STAGES)}[place + 1] AS stage FROM conversations, range(0, 5) AS g(place) WHERE role = 'user' AND (turn % 4 > 0 OR place = 0)")
def stage_events(spark: SparkSession, d: str) -> DataFrame:
    """Progress of each question; what the cache answers stops after its lookup."""
    stages = F.array(*map(F.lit, STAGES))
    run = F.when(F.col("turn") % 4 > 0, stages).otherwise(F.slice(stages, 1, 1))
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.posexplode(run).alias("place", "stage"))


@query("""
SELECT event_id, coalesce(last_value(switch IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'set', false) AS stopped
FROM (SELECT *, CASE event_id % 9 WHEN 3 THEN 'set' WHEN 7 THEN 'cleared' END AS switch FROM events)""")
def kill_switch(spark: SparkSession, d: str) -> DataFrame:
    """Whether an agent is stopped: the last control message up to now says so."""
    switch = F.when(F.col("event_id") % 9 == 3, "set").when(F.col("event_id") % 9 == 7, "cleared")
    last = F.last(switch, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events(spark, d).select("event_id", F.coalesce(last == "set", F.lit(False)).alias("stopped"))


ENTRIES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"response":{"answer":"a' || event_id || '"}}' WHEN 1 THEN '{"answer":"old"}' WHEN 2 THEN '{"response":"text"}' ELSE '{broken' END AS entry FROM events"""


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || event_id END AS answer FROM ({ENTRIES})")
def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """A cached entry answers only if its response is an object of today's shape."""
    kinds = [F.concat(F.lit('{"response":{"answer":"a'), "event_id", F.lit('"}}')), F.lit('{"answer":"old"}'), F.lit('{"response":"text"}'), F.lit("{broken")]
    entry = F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, d).select("event_id", F.from_json(entry, "response struct<answer:string>")["response"]["answer"].alias("answer"))


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents) WHERE regexp_full_match(word, '\p{Lu}+') GROUP BY word")
def acronyms(spark: SparkSession, d: str) -> DataFrame:
    """Words in capitals, which are no persons."""
    words = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.filter(t.is_acronym(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query(rf"SELECT conv_id, turn, regexp_replace(answer, '\[([0-9]+)\s*,\s*([0-9]+)\]', '[\1][\2]', 'g') AS answer FROM ({MARKED})")
def citation_lists(spark: SparkSession, d: str) -> DataFrame:
    """Answers with one number to a bracket."""
    return _marked(spark, d).select("conv_id", "turn", t.normalised(F.col("answer")).alias("answer"))


@query(f"""
WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 < 2), {spans.spans('old', 'doc_id')},
stale AS (SELECT doc_id, coalesce(redacted, text) AS text FROM old LEFT JOIN clean ON key = doc_id), {CHUNKS.format(docs='stale', most=100).strip().removeprefix('WITH ')}
SELECT doc_id, 2 AS version, doc_id % 3 < 2 AS rewritten, count(digest) AS n_chunks, coalesce(min(digest), '') AS least FROM documents LEFT JOIN (SELECT doc_id, md5(text) AS digest FROM chunks) USING (doc_id) GROUP BY doc_id""")
def stale_reprocess(spark: SparkSession, d: str) -> DataFrame:
    """Documents stored under older redaction rules are redacted and chunked anew; the others stay."""
    every = documents(spark, d).select("doc_id", "text", (F.col("doc_id") % 3).alias("version"))
    stale = every.filter("version < 2").select("doc_id", personal.redacted(F.col("text")).alias("text"))
    made = ingest.chunked(stale, 100).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.md5("text")).alias("digest"))
    both = every.select("doc_id", (F.col("version") < 2).alias("rewritten")).join(made, "doc_id", "left")
    return both.select("doc_id", F.lit(2).alias("version"), "rewritten", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("digest", F.lit("")).alias("least"))

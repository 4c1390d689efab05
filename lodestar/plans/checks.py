"""Rules and gates over the given tables: firewall, risk, coverage, headings, allowed calls, fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import personal, retries
from lodestar.functions import text as t
from lodestar.operators import governance, ingest, sent
from lodestar.plans.documents import SCORE, SPANS, documents
from lodestar.plans.operations import events
from lodestar.plans.registry import query
from lodestar.sources.tables import table

TEXTS = "SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS place, text FROM documents UNION ALL SELECT 'question', item_id, 0, text FROM benchmark UNION ALL SELECT 'message', conv_id, turn, text FROM conversations"


@query(f"""
SELECT kind, id, place, score, CASE WHEN score >= 0.95 THEN 'block' WHEN score >= 0.60 THEN 'flag' ELSE 'allow' END AS action, score < 0.60 AS may_be_stored, score < 0.95 AS may_be_asked
FROM (SELECT kind, id, place, ({SCORE})::DOUBLE AS score FROM (SELECT kind, id, place, coalesce(text, '') AS text FROM ({TEXTS})))""")
def firewall_actions(spark: SparkSession, d: str) -> DataFrame:
    """Every document, question and message before the firewall: what is stored must be allowed, a question may be flagged."""
    zero = F.lit(0).cast("long")
    rows = documents(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), zero.alias("place"), "text")
    rows = rows.unionByName(table(spark, d, "benchmark").select(F.lit("question").alias("kind"), F.col("item_id").alias("id"), zero.alias("place"), "text"))
    rows = rows.unionByName(table(spark, d, "conversations").select(F.lit("message").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("place"), "text"))
    text = F.coalesce("text", F.lit(""))
    scored = rows.select("kind", "id", "place", t.injection_score(text).alias("score"), t.action(t.injected(text), t.injection_score(text)).alias("action"))
    return scored.withColumns({"may_be_stored": F.col("action") == "allow", "may_be_asked": F.col("action") != "block"})


TIER = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{tier}'" for tier, p in governance.RISK_TIERS)


@query(f"""
SELECT doc_id, CASE {TIER} ELSE 'minimal' END AS tier, CASE WHEN regexp_matches(text, '{governance.CONSEQUENTIAL}') THEN '{','.join(governance.OBLIGATIONS)}' ELSE '' END AS obligations
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def risk_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """The tier and the duties of what each document describes."""
    text = F.coalesce("text", F.lit(""))
    return documents(spark, d).select("doc_id", governance.risk_tier(text).alias("tier"), F.array_join(governance.obligations(text), ",").alias("obligations"))


IDENTIFIERS = "(VALUES " + ", ".join(f"('{x}', {repr(e) if e else 'NULL'})" for x, e in governance.IDENTIFIERS) + ") AS h(identifier, entity)"


@query(f"""
WITH {SPANS}, found AS (SELECT type, count(*) AS n_spans, count(DISTINCT key) AS n_documents FROM accepted GROUP BY type)
SELECT identifier, coalesce(entity, '') AS entity, entity IS NOT NULL AS covered, coalesce(n_spans, 0) AS n_spans, coalesce(n_documents, 0) AS n_documents
FROM {IDENTIFIERS} LEFT JOIN found ON type = entity""")
def identifier_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each identifier of the safe harbour: whether a type covers it, and what of it the documents hold."""
    spans = documents(spark, d).select("doc_id", F.explode(personal.accepted(F.col("text"))).alias("s"))
    found = spans.groupBy(F.col("s.type").alias("type")).agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_documents"))
    listed = spark.createDataFrame(list(governance.IDENTIFIERS), "identifier string, entity string")
    both = listed.join(found, F.col("type") == F.col("entity"), "left")
    return both.select("identifier", F.coalesce("entity", F.lit("")).alias("entity"), F.col("entity").isNotNull().alias("covered"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@query("""
SELECT lang, metric, round(avg(score), 4) AS mean, round(avg(score), 4) >= max(floor) AS passes FROM (
  SELECT lang, 'quality' AS metric, quality::DOUBLE AS score, 0.70::DOUBLE AS floor FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT lang, 'harmless', 1 - toxic::DOUBLE, 0.90::DOUBLE FROM labels JOIN documents USING (doc_id)) GROUP BY lang, metric""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Means of the labels of each language against their floors."""
    both = table(spark, d, "labels").join(documents(spark, d).select("doc_id", "lang"), "doc_id")
    floors = F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("score"), F.lit(0.70).alias("floor")), F.struct(F.lit("harmless").alias("metric"), (1 - F.col("toxic")).cast("double").alias("score"), F.lit(0.90).alias("floor")))
    mean = F.round(F.avg("m.score"), 4)
    return both.select("lang", F.explode(floors).alias("m")).groupBy("lang", F.col("m.metric").alias("metric")).agg(mean.alias("mean"), (mean >= F.max("m.floor")).alias("passes"))


@query("""
WITH listed AS (SELECT DISTINCT user_id, event_type FROM events WHERE day(ts) <= 10)
SELECT event_id, l.user_id IS NOT NULL AS allowed FROM events e LEFT JOIN listed l ON l.user_id = e.user_id AND l.event_type = e.event_type WHERE day(ts) > 10""")
def allowed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the last twenty days are denied unless their caller is listed with that tool in the first ten."""
    every = events(spark, d).select("event_id", "user_id", "event_type", F.dayofmonth("ts").alias("day"))
    listed = every.filter("day <= 10").select("user_id", "event_type").distinct().withColumn("listed", F.lit(True))
    return every.filter("day > 10").join(listed, ["user_id", "event_type"], "left").select("event_id", F.coalesce("listed", F.lit(False)).alias("allowed"))


MARKDOWN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<h1[^>]*>', chr(10) || '# ', 'g'), '<h2[^>]*>', chr(10) || '## ', 'g'), '</h[12]>|<p[^>]*>|<br[^>]*>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g')"""


@query(rf"""
WITH md AS (SELECT page_id, {MARKDOWN} AS text FROM pages),
lines AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM md),
heads AS (SELECT page_id, place, length(regexp_extract(line, '^(#{{1,6}})\s+', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\s+(.*)$', 1)) AS title FROM lines WHERE regexp_matches(line, '^#{{1,6}}\s+.*$')),
above AS (SELECT *, max(CASE WHEN level = 1 THEN place END) OVER w AS p1, max(CASE WHEN level = 2 THEN place END) OVER w AS p2, row_number() OVER (PARTITION BY page_id ORDER BY place) AS section FROM heads WINDOW w AS (PARTITION BY page_id ORDER BY place))
SELECT a.page_id, section, a.level, array_to_string(list_filter([h1.title, CASE WHEN p2 > coalesce(p1, -1) THEN h2.title END], lambda x: x IS NOT NULL), ' > ') AS path
FROM above a LEFT JOIN heads h1 ON h1.page_id = a.page_id AND h1.place = p1 LEFT JOIN heads h2 ON h2.page_id = a.page_id AND h2.place = p2""")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """The headings of all pages as Markdown, each with the headings above it."""
    bare = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    for pattern, to in (("<h1[^>]*>", "\n# "), ("<h2[^>]*>", "\n## "), ("</h[12]>|<p[^>]*>|<br[^>]*>|</p>", "\n"), ("<[^>]*>", "")):
        bare = F.regexp_replace(bare, pattern, to)
    split = ingest.sections(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), bare.alias("text"))).filter("level > 0")
    return ingest.heading_paths(split).select(F.col("doc_id").alias("page_id"), F.col("section").cast("long").alias("section"), F.col("level").cast("long").alias("level"), F.array_join("heading_path", " > ").alias("path"))


@query("SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type AS event, coalesce(props, '') AS data FROM events")
def sent_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as one stream of server-sent text, cut every seven to thirteen characters, and read back."""
    frame = F.concat(F.lit(": "), F.col("event_id").cast("string"), F.lit("\r\nevent: "), "event_type", F.lit("\rdata: "), F.coalesce("props", F.lit("")), F.lit("\r\n\r\n"))
    whole = events(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", frame.alias("frame")))), lambda x: x.frame), "").alias("text"))
    size = F.lit(7) + (F.col("user_id") % 7).cast("int")
    cut = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))  # in one pass
    fragments = whole.select(F.col("user_id").alias("stream"), F.posexplode(cut).alias("seq", "text"))
    return sent.parsed(fragments).select("stream", F.col("n").cast("long").alias("n"), "event", "data")


def _retried(p: retries.Policy) -> str:
    """SQL of the schedule, over a list xs of outcomes."""
    again = f"((x.o = 'rate_limited' AND a.rate < {p.rate_limit_retries}) OR (x.o = 'transient' AND a.trans < {p.transient_retries}))"
    wait = lambda b, n: f"least({b[2]}, {b[0]} * pow({b[1]}, {n}))"
    state = "o := '', rate := 0, trans := 0, attempts := 0, waited := 0.0::DOUBLE, result := 'pending'"
    return f"""list_reduce(list_prepend(struct_pack({state}), list_transform(xs, lambda x: struct_pack({state.replace("o := ''", "o := x")}))), lambda a, x: CASE WHEN a.result <> 'pending' THEN a ELSE
      struct_pack(o := '', rate := a.rate + (x.o = 'rate_limited' AND {again})::INT, trans := a.trans + (x.o = 'transient' AND {again})::INT, attempts := a.attempts + 1,
        waited := a.waited + CASE WHEN NOT {again} THEN 0 WHEN x.o = 'rate_limited' THEN {wait(p.rate_limit, 'a.rate')} ELSE {wait(p.transient, 'a.trans')} END, result := CASE WHEN {again} THEN 'pending' ELSE x.o END) END)"""


@query(f"""
WITH c AS (SELECT user_id, ts::DATE AS day, list(CASE event_type WHEN 'error' THEN 'transient' WHEN 'signup' THEN 'rate_limited' WHEN 'click' THEN 'transient' ELSE 'ok' END ORDER BY ts, event_id) AS xs FROM events GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, kind, r.attempts::INTEGER AS attempts, r.waited::DOUBLE AS waited, r.result AS result FROM (
  SELECT user_id, day, 'ingestion' AS kind, {_retried(retries.INGESTION)} AS r FROM c UNION ALL SELECT user_id, day, 'query', {_retried(retries.QUERY)} FROM c UNION ALL SELECT user_id, day, 'classify', {_retried(retries.CLASSIFY)} FROM c)""")
def retry_schedules(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of a day as the outcomes of one call's attempts, under each policy."""
    outcome = F.when(F.col("event_type").isin("error", "click"), "transient").when(F.col("event_type") == "signup", "rate_limited").otherwise("ok")
    calls = events(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", outcome.alias("o")))).alias("xs"))
    kinds = (("ingestion", retries.INGESTION), ("query", retries.QUERY), ("classify", retries.CLASSIFY))
    each = calls.select("user_id", "day", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), retries.schedule(F.col("xs.o"), p).alias("r")) for k, p in kinds))).alias("s"))
    return each.select("user_id", "day", "s.kind", "s.r.attempts", "s.r.waited", "s.r.result")

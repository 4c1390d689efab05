"""Questions of `benchmark` answered from `documents`, and what the answers leave behind."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.functions.embed import PLACES
from lodestar.operators import answering, state
from lodestar.plans import spans
from lodestar.plans.documents import CHUNKS, SCORE
from lodestar.plans.registry import query
from lodestar.plans.retrieval import LEX
from lodestar.sources.store import written
from lodestar.sources.tables import table

TOKENS, LIMIT = 100, 3000
SENTENCE = re.sub(r"([+*])\+", r"\1", answering.SENTENCE)  # the same without possessive marks


def hashed_vectors(source: str, key: str, text: str) -> str:
    """A relation (key, vector) over the lexemes of source's text."""
    return f"""
  SELECT key, list_transform(sums, lambda x: x / CASE WHEN size = 0 THEN 1 ELSE size END) AS vector FROM (
    SELECT key, sums, sqrt(list_sum(list_transform(sums, lambda x: x * x))) AS size FROM (
      SELECT key, list(coalesce(s, 0)::DOUBLE ORDER BY p) AS sums FROM (SELECT {key} AS key, p FROM {source}, range(0, {PLACES}) AS g(p))
      LEFT JOIN (SELECT key, ('0x' || substr(md5(x), 1, 8))::BIGINT % {PLACES} AS p, sum(CASE WHEN substr(md5(x), 9, 1) >= '8' THEN -1 ELSE 1 END) AS s
                 FROM (SELECT {key} AS key, unnest({LEX.format(text)}) AS x FROM {source}) GROUP BY 1, 2) USING (key, p)
      GROUP BY key))"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), v AS ({hashed_vectors('d', 'doc_id', 'text')}), q AS ({hashed_vectors('benchmark', 'item_id', 'text')})
SELECT 'document' AS kind, key AS id, len(list_filter(vector, lambda x: x <> 0)) AS n_places, round(list_sum(list_transform(vector, lambda x, i: x * i)), 9) AS moment FROM v
UNION ALL SELECT 'question', key, len(list_filter(vector, lambda x: x <> 0)), round(list_sum(list_transform(vector, lambda x, i: x * i)), 9) FROM q""")
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Every document's and question's vector of hashed lexemes, by its places and moment."""
    documents = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.lit("question").alias("kind"), F.col("item_id").alias("id"), "text")
    made = documents.unionByName(asked).select("kind", "id", answering.embedded(F.col("text")).alias("v"))
    moment = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return made.select("kind", "id", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("n_places"), F.round(moment, 9).alias("moment"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Odd items are asked first; what they leave in the cache serves when all are asked."""
    chunks = written(answering.chunk_store(table(spark, d, "documents").select("doc_id", "text"), TOKENS), "chunks")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    none = spark.createDataFrame([], "at long, vector array<double>")
    first = written(answering.answered(asked.filter("qid % 2 = 1"), chunks, none, limit=LIMIT), "answers")
    cache = first.filter("cacheable").select(F.col("qid").alias("at"), "vector")
    return answering.answered(asked, chunks, cache, limit=LIMIT)


STOP = tuple(t.STOP_WORDS)


def _batch(name: str, asked: str, cache: str) -> str:
    """CTEs of one batch of questions; the last is `name`."""
    n = name
    parts = {}
    parts["asked"] = f"SELECT q.qid, question, vector, {SCORE.replace('text', 'question')} AS score, list_filter(list_distinct({LEX.format('question')}), lambda x: x NOT IN {STOP}) AS words FROM ({asked}) q JOIN qv ON key = qid"
    parts["hits"] = f"SELECT qid, max(seen) AS hit FROM {n}_asked a JOIN ({cache}) c ON a.score < 0.95 AND round(list_cosine_similarity(a.vector, c.kept), 9) >= 0.95 GROUP BY qid"
    parts["left"] = f"SELECT * FROM {n}_asked WHERE score < 0.95 AND qid NOT IN (SELECT qid FROM {n}_hits)"
    parts["dense"] = f"""SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank
  FROM (SELECT qid, id, round(1 - CASE WHEN list_sum(list_transform(l.vector, lambda x: abs(x))) * list_sum(list_transform(c.vector, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(l.vector, c.vector) END, 12) + 0.0 AS distance FROM {n}_left l, store c) QUALIFY rank <= 50"""
    parts["sparse"] = f"""SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, id) AS rank
  FROM (SELECT id, unnest({LEX.format('text')}) AS lexeme FROM store) JOIN (SELECT qid, unnest(words) AS lexeme FROM {n}_left) USING (lexeme) GROUP BY qid, id QUALIFY rank <= 50"""
    parts["fused"] = f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r1 NULLS LAST, r0 NULLS LAST, id::VARCHAR) AS rank FROM (
    SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, d.rank AS r0, s.rank AS r1, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 12) AS score
    FROM {n}_dense d FULL JOIN {n}_sparse s ON d.qid = s.qid AND d.id = s.id) QUALIFY rank <= 5"""
    parts["parents"] = f"SELECT qid, document_id, arg_min(id, rank) AS anchor_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS n FROM {n}_fused JOIN store USING (id) GROUP BY qid, document_id"
    parts["said"] = f"""SELECT qid, n, place, sentence, len(list_intersect(words, {LEX.format('sentence')})) AS shared FROM (
    SELECT p.qid, p.n, l.words, x.place, x.sentence FROM {n}_parents p JOIN {n}_left l USING (qid) JOIN told x USING (document_id))"""
    parts["best"] = f"SELECT qid, n, sentence, shared, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, n) AS place FROM (SELECT * FROM {n}_said QUALIFY row_number() OVER (PARTITION BY qid, n ORDER BY shared DESC, place) = 1)"
    parts["draft"] = f"""SELECT p.qid, count(*) AS total, coalesce(max(shared), 0) >= 1 AS relevant, max(s.score) AS exposure, list(struct_pack(n := p.n, anchor_id := anchor_id) ORDER BY p.n) AS retrieved,
    coalesce(string_agg(sentence || ' [' || p.n || ']', ' ' ORDER BY p.n) FILTER (b.place <= 3 AND shared >= 1), '') AS text, list(p.n ORDER BY p.n) FILTER (b.place <= 3 AND shared >= 1) AS cited
  FROM {n}_parents p JOIN sections s USING (document_id) LEFT JOIN {n}_best b ON b.qid = p.qid AND b.n = p.n GROUP BY p.qid"""
    made = ",\n".join(f"{n}_{k} AS ({v})" for k, v in parts.items())
    safe = spans.spans(f"{n}_draft", "qid")
    for cte in ("accepted", "kept", "clean"):
        safe = re.sub(rf"\b{cte}\b", f"{n}_{cte}", safe)
    checked = f"""{n}_checked AS (
  SELECT d.*, coalesce(redacted, text) AS answer, list_concat(list_concat(CASE WHEN d.qid IN (SELECT key FROM {n}_accepted) THEN ['output_pii'] ELSE [] END,
    CASE WHEN len(coalesce(cited, [])) = 0 THEN ['no_citations'] WHEN len(cited) / total < 0.5 THEN ['low_grounding'] ELSE [] END),
    CASE WHEN (len(coalesce(cited, [])) > 0)::INT + (exposure >= 0.60)::INT + regexp_matches(coalesce(redacted, text), '{t.URL}')::INT >= 2 THEN ['lethal_trifecta'] ELSE [] END) AS reasons
  FROM {n}_draft d LEFT JOIN {n}_clean ON key = d.qid
), {n}_charged AS (
  SELECT unnest(qids) AS qid, unnest(folded.ok) AS ok, unnest(folded.used) AS used FROM (
    SELECT qids, list_reduce(list_prepend(struct_pack(v := 0::BIGINT, total := 0::BIGINT, ok := []::BOOLEAN[], used := []::BIGINT[]), list_transform(vs, lambda v: struct_pack(v := v, total := 0::BIGINT, ok := []::BOOLEAN[], used := []::BIGINT[]))),
      lambda a, x: struct_pack(v := 0::BIGINT, total := a.total + CASE WHEN a.total + x.v <= {LIMIT} THEN x.v ELSE 0 END, ok := list_append(a.ok, a.total + x.v <= {LIMIT}), used := list_append(a.used, a.total + CASE WHEN a.total + x.v <= {LIMIT} THEN x.v ELSE 0 END))) AS folded
    FROM (SELECT list(qid ORDER BY qid) AS qids, list((length(answer) // 4)::BIGINT ORDER BY qid) AS vs FROM {n}_checked WHERE relevant))
), {n}_staged AS (
  SELECT a.qid, a.question, a.vector, h.hit, c.*EXCLUDE (qid), used / {LIMIT}::DOUBLE AS ratio,
    CASE WHEN a.score >= 0.95 THEN 'blocked' WHEN hit IS NOT NULL THEN 'cache_hit' WHEN total IS NULL THEN 'no_context' WHEN NOT relevant THEN 'irrelevant' WHEN NOT ok THEN 'over_quota' ELSE 'answered' END AS stage
  FROM {n}_asked a LEFT JOIN {n}_hits h USING (qid) LEFT JOIN {n}_checked c USING (qid) LEFT JOIN {n}_charged USING (qid)
), {n} AS (
  SELECT qid, question, vector, stage, hit, CASE WHEN stage = 'answered' THEN answer WHEN stage IN ('no_context', 'irrelevant') THEN '{answering.NOTHING.replace("'", "''")}' END AS answer,
    CASE WHEN stage = 'answered' THEN coalesce(cited, []) ELSE [] END AS cited, retrieved, coalesce(total, 0) - CASE WHEN stage = 'answered' THEN len(coalesce(cited, [])) ELSE 0 END AS uncited,
    CASE WHEN stage = 'cache_hit' THEN ['cache_hit'] WHEN stage = 'answered' THEN list_concat(reasons, CASE WHEN ratio >= 0.95 THEN ['quota_throttle'] WHEN ratio >= 0.80 THEN ['quota_warn'] ELSE [] END) ELSE [] END AS reasons,
    stage = 'answered' AND len(reasons) = 0 AS cacheable
  FROM {n}_staged
)"""
    return f"{made},\n{safe},\n{checked}"


LADDER = f"""
WITH fit AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S') AND {SCORE} < 0.60 GROUP BY text),
{CHUNKS.format(docs='fit', most=TOKENS).strip().removeprefix('WITH ')},
units AS (SELECT doc_id * 1000000 + chunk_index AS id, doc_id AS document_id, chunk_index, text FROM chunks),
uv AS ({hashed_vectors('units', 'id', 'text')}), qv AS ({hashed_vectors('benchmark', 'item_id', 'text')}),
store AS (SELECT u.*, vector FROM units u JOIN uv ON key = id),
sections AS (SELECT document_id, {SCORE} AS score, text FROM (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM units GROUP BY document_id)),
told AS (
  SELECT document_id, place, sentence FROM (
    SELECT document_id, unnest(xs) AS sentence, generate_subscripts(xs, 1) AS place FROM (
      SELECT document_id, list_filter(list_transform(regexp_extract_all(text, '{SENTENCE}'), lambda s: regexp_replace(regexp_replace(s, '{t.CITATIONS}', '', 'g'), '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS xs FROM sections))
),
FIRST,
EVERY
"""


def _ladder(select: str) -> str:
    first = _batch("b1", "SELECT item_id AS qid, text AS question FROM benchmark WHERE item_id % 2 = 1", "SELECT 0::BIGINT AS seen, []::DOUBLE[] AS kept WHERE false")
    every = _batch("b2", "SELECT item_id AS qid, text AS question FROM benchmark", "SELECT qid AS seen, vector AS kept FROM b1 WHERE cacheable ORDER BY qid DESC LIMIT 50")
    return LADDER.replace("FIRST,", first + ",").replace("EVERY", every) + select


@query(_ladder("SELECT qid, stage, hit, md5(coalesce(answer, '')) AS answer, array_to_string(cited, ',') AS cited, coalesce(array_to_string(list_transform(retrieved, lambda r: r.anchor_id), ','), '') AS retrieved, uncited::INTEGER AS uncited, array_to_string(reasons, ',') AS reasons, cacheable FROM b2"))
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """All questions through firewall, cache, retrieval, grading, extraction, checks and quota."""
    told = _answers(spark, d)
    return told.select(
        "qid", "stage", "hit", F.md5(F.coalesce("answer", F.lit(""))).alias("answer"), F.array_join("cited", ",").alias("cited"), F.array_join("retrieved.anchor_id", ",").alias("retrieved"),
        "uncited", F.array_join("reasons", ",").alias("reasons"), "cacheable",
    )


@query(_ladder("""SELECT qid, entry_hash FROM (
  WITH RECURSIVE e AS (SELECT qid, row_number() OVER (ORDER BY qid) AS n, '{"question":' || array_to_string(list_transform(string_split(to_json(question)::VARCHAR, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE printf('\\u%04x', unicode(c)) END), '') || ',"reasons":' || to_json(reasons) || '}' AS data FROM b2 WHERE stage = 'answered' AND len(reasons) > 0),
  c AS (SELECT qid, n, sha256(repeat('0', 64) || data) AS entry_hash FROM e WHERE n = 1 UNION ALL SELECT e.qid, e.n, sha256(c.entry_hash || e.data) FROM e JOIN c ON e.n = c.n + 1)
  SELECT * FROM c)"""))
def answer_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit chain of all flagged answers, in order of asking."""
    entries = answering.audit_rows(_answers(spark, d)).withColumn("tenant", F.lit(0))
    return state.chain(entries, ["tenant"], ["qid"], "event_data").select("qid", "entry_hash")

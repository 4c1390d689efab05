"""Retrieval queries. A chunk id is both a doc_id and a vec_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import STOP_WORDS, lexemes
from lodestar.functions.vector import cosine
from lodestar.operators import search, state
from lodestar.plans.registry import case, query
from lodestar.plans.service import folded
from lodestar.sources.tables import table

QUESTION = "the of and nding"
LEX = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"
POSTED = f"SELECT doc_id AS id, unnest({LEX.format('text')}) AS lexeme FROM documents"
MANY = "SELECT b.item_id AS qid, b.text AS question, e.embedding AS vector FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id"
ONE = f"SELECT 0::BIGINT AS qid, '{QUESTION}' AS question, embedding AS vector FROM embeddings WHERE vec_id = 0"
DENSE = f"""
  SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank
  FROM (SELECT qid, vec_id AS id, round(1 - {COS.format('embedding', 'vector')}, 12) + 0.0 AS distance FROM embeddings, questions)
  QUALIFY rank <= 50"""
SPARSE = f"""
  SELECT qid, id, count(*) AS hits, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, id) AS rank
  FROM ({POSTED}) p JOIN (SELECT DISTINCT qid, lexeme FROM (SELECT qid, unnest({LEX.format('question')}) AS lexeme FROM questions) WHERE lexeme NOT IN {tuple(STOP_WORDS)}) q USING (lexeme)
  GROUP BY qid, id QUALIFY rank <= 50"""
FUSED = """
WITH questions AS ({questions}), dense AS ({dense}), sparse AS ({sparse}),
fused AS (
  SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, d.rank AS r0, s.rank AS r1,
         round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 12) AS score
  FROM dense d FULL JOIN sparse s ON d.qid = s.qid AND d.id = s.id
)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r1 NULLS LAST, r0 NULLS LAST, id::VARCHAR)::INTEGER AS rank
FROM fused QUALIFY rank <= {k}"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def many_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return asked.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), "qid")


def one_question(spark: SparkSession, d: str) -> DataFrame:
    vector = table(spark, d, "embeddings").filter("vec_id = 0")
    return vector.select(F.lit(0).cast("long").alias("qid"), F.lit(QUESTION).alias("question"), F.col("embedding").alias("vector"))


@query(FUSED.format(questions=ONE, dense=DENSE, sparse=SPARSE, k=10))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """One question's dense and sparse pools, fused."""
    return search.hybrid(texts(spark, d), vectors(spark, d), one_question(spark, d)).select("qid", "id", "score", "rank")


@query(FUSED.format(questions=MANY, dense=DENSE, sparse=SPARSE, k=5))
def hybrid_many_questions(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(texts(spark, d), vectors(spark, d), many_questions(spark, d), k=5).select("qid", "id", "score", "rank")


@query(f"WITH questions AS ({ONE}) SELECT id, distance, rank::INTEGER AS rank FROM ({DENSE}) WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.dense(vectors(spark, d), one_question(spark, d), 10).select("id", "distance", "rank")


@query(f"WITH questions AS ({MANY}) SELECT qid, id, distance, rank::INTEGER AS rank FROM ({DENSE}) WHERE rank <= 5")
def dense_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    return search.dense(vectors(spark, d), many_questions(spark, d), 5).select("qid", "id", "distance", "rank")


@query(f"WITH questions AS ({MANY}) SELECT qid, id, hits::BIGINT AS hits, round(hits * 0.1::DOUBLE, 6) AS score, rank::INTEGER AS rank FROM ({SPARSE})")
def sparse_rank(spark: SparkSession, d: str) -> DataFrame:
    found = search.sparse(texts(spark, d), many_questions(spark, d))
    return found.select("qid", "id", "hits", F.round(F.col("hits") * 0.1, 6).alias("score"), "rank")


@query(f"SELECT doc_id, source FROM documents WHERE list_has_any({LEX.format('text')}, ['thea', 'onre', 'rely', 'ereaure'])")
def sparse_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold any of the question's words."""
    asked = F.array(*map(F.lit, ("thea", "onre", "rely", "ereaure")))
    return table(spark, d, "documents").filter(F.arrays_overlap(lexemes(F.col("text")), asked)).select("doc_id", "source")


TIES = """(VALUES (1, 'a', 1, 2), (1, 'b', 2, 1), (1, 'c', 3, NULL), (1, 'd', NULL, 3), (2, 'x', 1, NULL), (2, 'w', NULL, 1), (3, 'q', 5, 5), (3, 'p', 5, 5)) AS t(qid, id, r0, r1)"""


@case(f"""
SELECT qid, id, round(coalesce(1.0::DOUBLE / (60 + r0), 0) + coalesce(1.0::DOUBLE / (60 + r1), 0), 12) AS score,
       row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(1.0::DOUBLE / (60 + r0), 0) + coalesce(1.0::DOUBLE / (60 + r1), 0), 12) DESC, r1 NULLS LAST, r0 NULLS LAST, id)::INTEGER AS rank
FROM {TIES}""")
def rrf_tie_rule(spark: SparkSession, d: str) -> DataFrame:
    """Equal scores go to the better rank in the last list."""
    rows = spark.sql(f"SELECT * FROM {TIES}")
    lists = [rows.filter(F.col(r).isNotNull()).select("qid", "id", F.col(r).alias("rank")) for r in ("r0", "r1")]
    return search.fuse(lists, 10).select("qid", "id", "score", "rank")


SECTIONS = "SELECT conv_id * 100 + turn AS id, conv_id AS document_id, role AS heading_path, turn AS chunk_index, text FROM conversations"
RANKED = "SELECT id, row_number() OVER (ORDER BY (id * 7919) % 10007, id) AS rank FROM chunks QUALIFY rank <= 40"


@query(f"""
WITH chunks AS ({SECTIONS}), ranked AS ({RANKED}),
best AS (SELECT document_id, heading_path, min(rank) AS rank, arg_min(id, rank) AS anchor_id FROM ranked JOIN chunks USING (id) GROUP BY ALL)
SELECT document_id, heading_path, rank::INTEGER AS rank, anchor_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text
FROM best JOIN chunks USING (document_id, heading_path) GROUP BY document_id, heading_path, rank, anchor_id""")
def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    """Ranked chunks widened to their sections, one row per section."""
    every = table(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.col("role").alias("heading_path"), F.col("turn").alias("chunk_index"), "text"
    )
    first = every.select("id").orderBy((F.col("id") * 7919) % 10007, "id").limit(40)
    ranked = search.best(first.withColumn("one", F.lit(1)), "one", [(F.col("id") * 7919) % 10007, F.col("id")], 40)
    return search.parents(ranked, every).select("document_id", "heading_path", "rank", "anchor_id", "text")


@query("""
SELECT conv_id, string_agg('<chunk id="' || n || '">' || chr(10) || text || chr(10) || '</chunk>', chr(10) || chr(10) ORDER BY n) AS context
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') GROUP BY conv_id""")
def context_string(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    tag = lambda p, i: F.concat(F.lit('<chunk id="'), i + 1, F.lit('">\n'), p.text, F.lit("\n</chunk>"))
    return said.select("conv_id", F.array_join(F.transform("parts", tag), "\n\n").alias("context"))


@query(f"""
WITH cache AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS age FROM embeddings QUALIFY age <= 50)
SELECT q.vec_id AS query_id, max(c.vec_id) AS hit_id
FROM embeddings q JOIN cache c ON q.label = c.label AND round({COS.format('q.embedding', 'c.embedding')}, 9) >= 0.30 AND c.vec_id <> q.vec_id
GROUP BY q.vec_id""")
def semantic_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The newest cached entry of the tenant that is near enough; not the nearest."""
    every = table(spark, d, "embeddings")
    cache = state.trimmed(every, "label", [F.desc("vec_id")]).select("label", F.col("vec_id").alias("hit_id"), F.col("embedding").alias("kept"))
    asked = every.select(F.col("vec_id").alias("query_id"), "label", "embedding")
    near = asked.join(cache, "label").filter((F.col("hit_id") != F.col("query_id")) & (F.round(cosine(F.col("embedding"), F.col("kept")), 9) >= 0.30))
    return near.groupBy("query_id").agg(F.max("hit_id").alias("hit_id"))


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 20")
def cache_trim(spark: SparkSession, d: str) -> DataFrame:
    return state.trimmed(table(spark, d, "embeddings").select("label", "vec_id"), "label", [F.desc("vec_id")], 20)


@query("SELECT 0::BIGINT AS n_dense, 0::BIGINT AS n_sparse")
def stop_word_question(spark: SparkSession, d: str) -> DataFrame:
    """A question of stop words alone matches nothing; one without a vector neither."""
    asked = spark.sql("SELECT 0L AS qid, 'what is the and of' AS question, CAST(array() AS array<double>) AS vector")
    sparse = search.sparse(texts(spark, d), asked).agg(F.count("*").alias("n_sparse"))
    return search.dense(vectors(spark, d).filter("embedding IS NULL"), asked).agg(F.count("*").alias("n_dense")).join(sparse)


CACHE_ROWS = "SELECT vec_id AS at, label AS tenant_id, vec_id % 97 = 13 AS invalidates, embedding FROM embeddings"


EMPTIED = "(x.gone OR coalesce(x.clock - a.stored >= 60, false))"
HELD = f"CASE WHEN {EMPTIED} THEN [] ELSE a.entries END"
HIT = f"list_filter({HELD}, lambda e: list_cosine_similarity(x.v, e.v) >= 0.30)"
LOOKED = f"(x.gone OR x.v IS NULL OR len({HIT}) > 0)"
REPLAYED = folded(
    "label", {"clock": "clock", "gone": "id % 97 = 13", "v": "embedding::DOUBLE[]"}, {"entries": "[]::STRUCT(h BIGINT, v DOUBLE[])[]", "stored": "NULL::BIGINT", "out": "[]::STRUCT(h BIGINT, n BIGINT)[]"},
    {
        "entries": f"CASE WHEN {LOOKED} THEN {HELD} ELSE list_prepend(struct_pack(h := x.clock, v := x.v), {HELD})[:50] END", "stored": f"CASE WHEN NOT {LOOKED} THEN x.clock WHEN {EMPTIED} THEN NULL ELSE a.stored END",
        "out": f"list_append(a.out, struct_pack(h := CASE WHEN NOT x.gone AND x.v IS NOT NULL THEN {HIT}[1].h END, n := CASE WHEN {LOOKED} THEN len({HELD}) ELSE least(len({HELD}) + 1, 50) END))",
    }, "SELECT vec_id AS id, vec_id AS clock, label, embedding FROM embeddings",
)


@query(f"SELECT id AS \"at\", label AS tenant_id, o.h AS hit_at, o.n::INTEGER AS held FROM ({REPLAYED}) JOIN embeddings ON vec_id = id")
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """A tenant's questions in order against its cache: a miss is stored, the list
    ends some time after its last store, and a deletion empties it."""
    table(spark, d, "embeddings").createOrReplaceTempView("embeddings")
    return state.cached(spark.sql(CACHE_ROWS), ["tenant_id"], "at", "embedding", 0.30, 60.0, 50).select("at", "tenant_id", "hit_at", "held")

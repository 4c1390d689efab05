"""The corpus operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, fingerprint, lm, mixing, neighbours, pii, quality, resample, runs, simhash, substrings, topk
from lodestar.llm.common import persist, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and the bytes."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(
        documents,
        bpe.read_ranks(RANKS),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
        drop=("text",),
    )


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE_SQL["op2_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
         regexp_replace(text, '(<)(\\*)(\|turn\|>|\|text\|>|\|end\|>)', '\1\\\2\3', 'g') AS safe
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(role) + length('<|text|>') + length(safe) + length('<|end|>'))::BIGINT AS formatted_chars,
       bool_and(CASE WHEN was IS NULL THEN role IN ('system', 'user') WHEN was IN ('system', 'assistant') THEN role = 'user'
                     WHEN was = 'user' THEN role = 'assistant' ELSE false END)
         AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM o GROUP BY conv_id
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus mixed to weights in proportion to the root of each source's size."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    sizes = persist(mixing.sizes(documents), "sizes")
    return mixing.mix(documents, persist(mixing.rates(sizes, mixing.tempered(sizes)), "rates"))


ORACLE_SQL["op5_mixing"] = r"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN size > 0 THEN sqrt(size::DOUBLE) / sum(sqrt(size::DOUBLE)) OVER () * (sum(size) OVER ())::DOUBLE / size::DOUBLE ELSE 0.0 END AS rate FROM s),
d AS (
  SELECT doc_id, text, lang, d.source, rate, coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, ''))) AS key,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), terms AS (
  SELECT source, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) ELSE (k = 0)::DOUBLE END) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, range(0, (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 13)::BIGINT FROM r)) AS g(k)
), n AS (
  SELECT d.source, d.key, count(*) FILTER (u >= cdf) AS n
  FROM d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, d.key
)
SELECT doc_id, text, lang, d.source, c::INTEGER AS copy, md5('42/order:' || d.key || ':' || c) AS mix_key
FROM d JOIN n USING (key), range(0, n.n) AS g(c)
"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document id in its class."""
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document and its edited text, and their likeness."""
    return fingerprint.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.ints::DOUBLE[], c.ints::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps once strings of 400 bytes that occur twice are gone."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(documents, 400, keep=("doc_id",), with_text=False)


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by pattern and by disclosing terms."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


@query
def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability; one residue of the id's CRC-32 in five is held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return lm.score(documents, held)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of trusted text, and whether it is kept."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.classify(documents, table(spark, sf_dir, "labels"), keep_text=False)


@query
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, and the tenth that is drawn."""
    documents, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    found = resample.resample(documents, target, longest=1, buckets=10_000, percent=10, least_words=20, seed=2024, keep=("doc_id",))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL["op11_resample"] = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS v FROM range(256) AS g(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), spelt AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(0, length(x) // 2 + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ('0x' || substr(x, 2 * i - 1, 2))::BIGINT END),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelt, tab
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM counted)::DOUBLE + 10000)) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM counted)::DOUBLE + 10000))))::BIGINT AS gain
  FROM counted
), of AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN of ON d.doc_id = of.doc_id
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""


@query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, some of which are made periodic from a word of
    their own on, and the digest of what is left without the repetitions."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """What use makes of a value that is worked out once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def periodic(s: Column) -> Column:
        left = F.size(s.words) - s.a
        period = (1 + F.floor(left / (3 + s.g % 8))).cast("int")
        piece = F.slice(s.words, s.a + 1, F.least(period, left))
        repeated = F.slice(F.flatten(F.array_repeat(piece, F.ceil(left / F.size(piece)).cast("int"))), F.lit(1), left)
        return F.array_join(F.concat(F.slice(s.words, F.lit(1), s.a), repeated), " ")

    start = lambda s: bound(F.struct(s.words.alias("words"), s.g.alias("g"), (s.g % F.size(s.words)).cast("int").alias("a")), periodic)
    changed = bound(F.struct(words.alias("words"), F.floor(h / 10).alias("g")), lambda s: F.when(F.size(s.words) > 0, start(s)).otherwise(""))
    made = documents.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))
    return runs.collapse(made, outputs=("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"), drop=("text",))


@query
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found of every twentieth vector, by inner product."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)

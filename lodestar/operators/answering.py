"""From questions to checked answers, as one plan.

Every question carries the stage at which it ended, and a later stage sees only
what is left: the firewall, the semantic cache, retrieval, grading, extraction of an
answer, checks of the answer, and the quota. Questions are a stated set; chunks are
the corpus and must be stored (they are read by both searches and for sections).

Stages: blocked, cache_hit, no_context, irrelevant, over_quota, answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import personal
from lodestar.functions import text as t
from lodestar.functions.embed import embedded
from lodestar.functions.vector import cosine
from lodestar.operators import ingest, search, state
from lodestar.sources.store import written

NOTHING = "I don't have any relevant information to answer this question."
#: Similarity from which a cached answer serves, and answers that a cache holds.
ALIKE, HELD = 0.95, 50
#: Sentences of an answer, and lexemes that context must share with the question.
SENTENCES, OVERLAP = 3, 1
EXPOSED = 0.60
#: A mark with no white space after it, as in an address, ends no sentence. Possessive, so that long texts need no stack.
SENTENCE = r"[^.!?\n]+(?:[.!?]++[^\s.!?][^.!?\n]*+)*+[.!?]*"


def chunk_store(docs: DataFrame, most_tokens: int = 400) -> DataFrame:
    """id, document_id, heading_path, chunk_index, text, embedding of the chunks of all
    documents (doc_id, text) that the firewall allows, one for each content."""
    hashed = docs.withColumn("__hash", t.content_hash(F.col("text")))
    fit = hashed.filter((ingest.bounds(F.col("text"), 2**31 - 1) == "accepted") & (t.injection_score(F.col("text")) < t.FLAGGED))
    first = fit.groupBy("__hash").agg(F.min("doc_id").alias("doc_id"))  # judged once: what has the hash is fit too
    chunks = ingest.chunked(hashed.join(first, ["__hash", "doc_id"]).select("doc_id", "text"), most_tokens)
    number = F.col("doc_id") * 1_000_000 + F.col("chunk_index")
    return chunks.select(number.alias("id"), F.col("doc_id").alias("document_id"), "heading_path", "chunk_index", "text", embedded(F.col("text")).alias("embedding"))


def sentences(text: Column) -> Column:
    """What line ends and marks before white space part, without white space around it and
    without numbers in brackets, which only the answer may hold."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_replace(F.regexp_replace(s, t.CITATIONS, ""), r"^\s+|\s+$", ""))
    return F.filter(bare, lambda s: s != "")


def cache_lookup(asked: DataFrame, cache: DataFrame, alike: float = ALIKE, held: int = HELD) -> DataFrame:
    """qid, hit: the newest of the cache's entries (at, vector) that is alike enough. The
    cache is bounded by the number of entries that it holds, so it is broadcast."""
    newest = cache.orderBy(F.desc("at")).limit(held).select(F.col("at").alias("hit"), F.col("vector").alias("kept"))
    near = asked.join(F.broadcast(newest), F.round(cosine(F.col("vector"), F.col("kept")), 9) >= alike)
    return near.groupBy("qid").agg(F.max("hit").alias("hit"))


def drafted(asked: DataFrame, chunks: DataFrame, top_k: int = 5, pool: int = search.POOL) -> DataFrame:
    """qid, total (sections found), relevant, cited, answer, retrieved, exposure (highest
    injection score of the context): the sentence of each section that shares most
    lexemes with the question, of up to three sections, each with its number."""
    ranked = search.hybrid(chunks.select("id", "text"), chunks.select("id", "embedding"), asked.select("qid", "question", "vector"), top_k, pool)
    numbered, texts = search.parents_of(ranked, chunks)
    split = texts.select("document_id", "heading_path", t.injection_score(F.col("text")).alias("score"), sentences(F.col("text")).alias("sentences"))
    words = asked.select("qid", t.asked(F.col("question")).alias("asked"))
    each = numbered.join(split, ["document_id", "heading_path"]).join(words, "qid")
    shared = F.size(F.array_intersect("asked", t.lexemes(F.col("sentence"))))
    told = each.select("qid", "n", "anchor_id", "score", "asked", F.posexplode_outer("sentences").alias("place", "sentence"))
    best = told.groupBy("qid", "n", "anchor_id", "score").agg(F.max(F.struct(F.coalesce(shared, F.lit(0)).alias("shared"), (-F.col("place")).alias("place"), F.col("sentence").alias("sentence"))).alias("best"))
    chosen = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("best.shared"), "n")) <= SENTENCES
    picked = best.withColumn("used", chosen & (F.col("best.shared") >= OVERLAP))
    parts = F.array_sort(F.collect_list(F.when(F.col("used"), F.struct("n", F.concat(F.col("best.sentence"), F.lit(" ["), "n", F.lit("]")).alias("said")))))
    made = picked.groupBy("qid").agg(
        F.count("*").cast("int").alias("total"), F.max(F.col("best.shared") >= OVERLAP).alias("relevant"), F.max("score").alias("exposure"),
        F.array_sort(F.collect_list(F.struct("n", "anchor_id"))).alias("retrieved"), parts.alias("parts"),
    )
    return made.select("qid", "total", "relevant", "exposure", "retrieved", F.array_join("parts.said", " ").alias("answer"))


def checked(drafts: DataFrame, registry: tuple[str, ...] = ()) -> DataFrame:
    """drafts with cited, reasons and the answer as it may be shown."""
    spans = personal.accepted(F.col("answer"))
    found = drafts.withColumn("spans", spans).withColumn("cited", F.filter(t.citations(F.col("answer")), lambda x: x.between(1, F.col("total"))))
    safe = found.withColumn("answer", personal.rebuilt(F.col("answer"), personal.resolved(F.col("spans"))))
    leaked = F.size(t.canaries(F.col("answer"), F.array(*map(F.lit, registry)).cast("array<string>"))) > 0
    conditions = (F.size("cited") > 0).cast("int") + (F.coalesce("exposure", F.lit(0.0)) >= EXPOSED).cast("int") + F.col("answer").rlike(t.URL).cast("int")
    reasons = F.concat(
        F.when(F.size("spans") > 0, F.array(F.lit("output_pii"))).otherwise(F.array().cast("array<string>")), t.grounding(F.size("cited"), F.col("total")),
        F.when(leaked, F.array(F.lit("canary_leak"))).otherwise(F.array().cast("array<string>")), F.when(conditions >= 2, F.array(F.lit("lethal_trifecta"))).otherwise(F.array().cast("array<string>")),
    )
    return safe.withColumn("reasons", reasons).drop("spans")


def answered(questions: DataFrame, chunks: DataFrame, cache: DataFrame, top_k: int = 5, limit: float = 100_000, registry: tuple[str, ...] = ()) -> DataFrame:
    """qid, question, vector, stage, hit, answer, cited, retrieved, uncited, reasons, flagged,
    cacheable. questions: qid (in order of asking), question; cache: at, vector (what
    earlier batches stored; this batch's own answers serve the next).

    The quota counts answers in order, four characters a token; what would pass it is
    refused and adds nothing. Only an answer without a reason is cacheable."""
    asked = questions.select("qid", "question", embedded(F.col("question")).alias("vector"), t.action(t.injected(F.col("question")), t.injection_score(F.col("question"))).alias("action"))
    hits = cache_lookup(asked.filter("action <> 'block'").select("qid", "vector"), cache)
    staged = asked.join(hits, "qid", "left")
    left = staged.filter("action <> 'block' AND hit IS NULL")
    drafts = written(checked(drafted(left, chunks, top_k), registry), "drafts")  # read twice: a few rows a question
    spent = drafts.filter("relevant").select(F.lit(0).alias("tenant"), "qid", F.floor(F.length("answer") / 4).cast("double").alias("tokens"))
    charged = state.quota(spent, float(limit), ["tenant"], ["qid"], "tokens").select("qid", "accepted", (F.col("used") / float(limit)).alias("ratio"))
    every = staged.join(drafts, "qid", "left").join(charged, "qid", "left")
    stage = (
        F.when(F.col("action") == "block", "blocked").when(F.col("hit").isNotNull(), "cache_hit").when(F.col("total").isNull(), "no_context")
        .when(~F.col("relevant"), "irrelevant").when(~F.col("accepted"), "over_quota").otherwise("answered")
    )
    placed = every.withColumn("stage", stage)
    answer = F.when(F.col("stage") == "answered", F.col("answer")).when(F.col("stage").isin("no_context", "irrelevant"), F.lit(NOTHING))
    quota = F.when(F.col("ratio") >= 0.95, F.array(F.lit("quota_throttle"))).when(F.col("ratio") >= 0.80, F.array(F.lit("quota_warn"))).otherwise(F.array().cast("array<string>"))
    done = F.col("stage") == "answered"
    none = F.array().cast("array<string>")
    return placed.select(
        "qid", "question", "vector", "stage", "hit", answer.alias("answer"), F.when(done, F.col("cited")).otherwise(F.array().cast("array<int>")).alias("cited"),
        F.coalesce("retrieved", F.array().cast("array<struct<n:int,anchor_id:bigint>>")).alias("retrieved"), (F.coalesce("total", F.lit(0)) - F.when(done, F.size("cited")).otherwise(0)).alias("uncited"),
        F.when(F.col("stage") == "cache_hit", F.array(F.lit("cache_hit"))).when(done, F.concat("reasons", quota)).otherwise(none).alias("reasons"),
        (done & (F.size(F.concat("reasons", quota)) > 0)).alias("flagged"), (done & (F.size("reasons") == 0)).alias("cacheable"),
    )


def review_rows(answers: DataFrame) -> DataFrame:
    """What waits for a person: flagged answers with their reasons."""
    return answers.filter("flagged").select("qid", "question", "answer", "reasons", F.lit("pending").alias("status"))


def audit_rows(answers: DataFrame) -> DataFrame:
    """Entries of the audit log for flagged answers: qid, event_type, event_data."""
    told = t.canonical({"question": F.col("question"), "reasons": F.col("reasons")})
    return answers.filter("flagged").select("qid", F.lit("query.flagged").alias("event_type"), told.alias("event_data"))

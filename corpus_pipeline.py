"""From raw documents to token ids: five stages, each over all that the one before kept.

STAGES: (name, function); a function takes (spark, docs, sf_dir). All but the
last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, mixing, pii, quality, simhash
from lodestar.llm.common import persist, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle; near copies share four fifths of their shingles.
SHINGLE = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    A null or empty text has no perplexity and stays; a null language is a language of its own; repeated rows
    and rows that share an id are judged each; labels of absent documents are harmless; without trusted text all
    stay; an empty table stays empty; columns beyond COLUMNS are dropped here and in each stage."""
    scored = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter("keep").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Of a group the smallest id stays; of rows that share an id the first by text; texts without words
    (null, empty, white space) are one group; texts of fewer than SHINGLE words are compared as a
    whole; an empty table stays empty."""
    return simhash.deduplicate(docs.select(*COLUMNS), SHINGLE)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, generalised.

    A null text stays null and an empty one empty; n_chars follows the text; rows that share an id share the
    terms that disclose; repeated rows stay; an empty table stays empty."""
    return pii.sanitise(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed in proportion to the root of their size, in one global order.

    A null source is a source of its own; a source whose texts are all null or empty has rate 0 and goes; rows with
    null ids are drawn by their text; repeated rows are drawn alike; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    sizes = persist(mixing.sizes(docs), "sizes")
    return mixing.mix(docs, persist(mixing.rates(sizes, mixing.tempered(sizes)), "rates")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document.

    A null or empty text has no ids; repeated rows stay; an empty table stays empty; given columns named ids or
    n_tokens are replaced."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN, outputs=("ids", "n_tokens"), drop=("text",))


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Word models, Hamming classes and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

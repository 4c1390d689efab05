"""A stored inverted index: (lexeme, ids, ns: lists of positions and how often they hold it), in folders by a hash of the lexeme.

Batches are appended. A bucket's lists are dealt to several tasks by a hash of their first
chunk, so a lexeme that a third of all chunks hold is no single task's; files are sorted
by lexeme, so that a search reads the folders of its lexemes and in them the row
groups that hold them. With `stems`, postings are of stems, worked out in the task that
reads the text. A chunk's id should come once; where it comes again its counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.stem import stem, stemmed
from lodestar.functions.text import asked
from lodestar.operators import search
from lodestar.operators.search import MOST_ASKED, POOL, best
from lodestar.sources.store import Versioned

BUCKETS, PIECES = 64, 4
#: Lexemes that are named in the filter of the scan; more are only joined.
NAMED = 1000


def index(spark, folder: str) -> Versioned:
    return Versioned(spark, folder, ("bucket",))


def bucket(lexeme: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def with_stems(rows: DataFrame) -> DataFrame:
    """rows with their lexeme replaced by its stem."""
    words = rows.select("lexeme").distinct().select(F.col("lexeme").alias("__word"), stemmed(F.col("lexeme")).alias("__stem"))
    return rows.join(words, F.col("lexeme") == F.col("__word")).withColumn("lexeme", F.col("__stem")).drop("__word", "__stem")


def listed(chunks: DataFrame, stems: bool) -> DataFrame:
    """lexeme, ids, ns: lists of the positions that hold a lexeme, and how often, of texts that one task reads together."""
    kind = chunks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, word, row, n in search.tallied(batches, change=stem if stems else None):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            ends = pa.array(np.append(first, len(word)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, ids.take(pa.array(row))), pa.ListArray.from_arrays(ends, pa.array(n))]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(word[first])), *lists], names=["lexeme", "ids", "ns"])

    return chunks.select("id", F.lower("text").alias("text")).mapInArrow(run, f"lexeme string, ids array<{kind}>, ns array<bigint>")


def add(table: Versioned, batch_id: str, chunks: DataFrame, stems: bool = False, buckets: int = BUCKETS) -> int:
    """Adds the postings of chunks (id, text)."""
    placed = listed(chunks, stems).withColumn("bucket", bucket("lexeme", buckets))
    dealt = placed.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(PIECES))).sortWithinPartitions("bucket", "lexeme")
    return table.append(batch_id, dealt)


def _held(table: Versioned, wanted: DataFrame, buckets: int) -> DataFrame:
    """The stored postings in the folders, and if they are few enough to be named in the row groups, of wanted's lexemes."""
    words = wanted.select("lexeme").distinct()
    folders = sorted(r.bucket for r in words.select(bucket("lexeme", buckets).alias("bucket")).distinct().collect())  # at most as many as buckets
    held = table.read().filter(F.col("bucket").isin(folders))
    named = words.limit(NAMED + 1).collect()
    return held.filter(F.col("lexeme").isin([r.lexeme for r in named])) if len(named) <= NAMED else held


def _rows(held: DataFrame, *columns: str) -> DataFrame:
    """Lists of postings as rows: columns, id, n."""
    return held.select(*columns, F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("ns").alias("n"))))


def _wanted(questions: DataFrame, stems: bool) -> DataFrame:
    wanted = questions.select("qid", F.explode(asked(F.col("question"))).alias("lexeme"))
    return with_stems(wanted).distinct() if stems else wanted


def matches(table: Versioned, questions: DataFrame, stems: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """qid, id, hits: positions that hold any of the question's lexemes. questions: qid, question."""
    wanted = _wanted(questions, stems)
    few = wanted.limit(MOST_ASKED + 1).count() <= MOST_ASKED
    return _rows(_held(table, wanted, buckets), "lexeme").join(F.broadcast(wanted) if few else wanted, "lexeme").groupBy("qid", "id").agg(F.sum("n").alias("hits"))


def sparse(table: Versioned, questions: DataFrame, k: int = POOL, stems: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """qid, id, hits, rank: as search.sparse, from the index."""
    wanted = _wanted(questions, stems)
    few = search.bounded(wanted)
    if few is None:
        return best(matches(table, questions, stems, buckets), "qid", [F.desc("hits"), F.col("id")], k)
    numbers = wanted.sparkSession.createDataFrame(list(enumerate(few.words)), "word int, lexeme string")
    held = _held(table, wanted, buckets)
    known = _rows(held.join(F.broadcast(numbers), "lexeme"), "word").select("id", "word", "n")
    return search.top(known, few, (wanted.schema["qid"].dataType.simpleString(), known.schema["id"].dataType.simpleString()), k)

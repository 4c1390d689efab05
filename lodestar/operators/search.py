"""Dense, sparse and hybrid retrieval for many questions at once.

Questions are a stated, small set; chunks are the corpus. Every ranking
ends in a unique key. Spark decides on broadcasts by size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import asked, lexemes, split_lexemes

POOL, RRF_K, DIGITS = 50, 60, 12


def best(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k of each group, with rank from 1."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def arrow(kind: str) -> pa.DataType:
    """The type of a key."""
    return pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()


#: Vectors of a block of chunks and of a block of questions.
CHUNKS, QUESTIONS = 4096, 2048
#: Blocks of questions that are broadcast (each at most QUESTIONS vectors); more are shuffled.
MOST_BLOCKS = 16


def _blocks(rows: DataFrame, size: int, key: str, vector: str) -> DataFrame:
    """n, dim, ids (array of the key's type), raw (vectors of double, one behind the other) of
    up to size rows of equal length."""
    kind = rows.schema[key].dataType.simpleString()
    one = arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, parts = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids], pa.list_(one)), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["n", "dim", "ids", "raw"])

        for batch in batches:
            for i, (key_, vector_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                x = vector_.values.to_numpy(zero_copy_only=False)
                ids, parts = held.setdefault(len(x), ([], []))
                ids.append(key_)
                parts.append(x)
                if len(ids) == size:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    plain = rows.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    return plain.mapInArrow(run, f"n int, dim int, ids array<{kind}>, raw binary")


def _away(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    sizes = np.outer(np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)))
    return np.round(1 - np.where(sizes == 0, 0.0, q @ x.T / np.where(sizes == 0, 1, sizes)), DIGITS) + 0.0


def _nearest(chunks: DataFrame, blocks: list, k: int, types: list, kinds: list[str]) -> DataFrame:
    """qid, id, distance: of each task's chunks those that may be among the k nearest of a question. blocks:
    a bounded number, of which every task has a copy; the distance of the k-th so far rules most chunks out."""
    made = []
    for dim in sorted({b.qdim for b in blocks}):
        same = [b for b in blocks if b.qdim == dim]
        qids, q = pa.array([x for b in same for x in b.qids], types[1]), np.concatenate([np.frombuffer(b.qraw).reshape(b.qn, dim) for b in same])
        made += [(dim, qids.slice(i, QUESTIONS), q[i : i + QUESTIONS]) for i in range(0, len(q), QUESTIONS)]
    shared = chunks.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.full((len(q), k), np.inf) for _, _, q in shared.value]
        for whole in batches:
            dims = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                same = whole if (dims == dim).all() else whole.filter(pa.array(dims == dim))
                for start in range(0, len(same), CHUNKS):
                    part = same.slice(start, CHUNKS)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
                    for i, (qdim, qids, q) in enumerate(shared.value):
                        if qdim == dim:
                            away = _away(q, x)
                            order = np.where(np.isnan(away), np.inf, away)
                            kept[i] = np.sort(np.hstack([kept[i], np.partition(order, k - 1, axis=1)[:, :k] if len(part) > k else order]), axis=1)[:, :k]
                            of, at = np.nonzero(order <= kept[i][:, -1:])
                            ids = part.column(0)
                            named = pc.rank(ids.take(pa.array(at)), tiebreaker="first").to_numpy(zero_copy_only=False)
                            placed = np.lexsort((named, order[of, at], of))
                            rank = np.arange(len(of)) - np.searchsorted(of, of)
                            of, at = of[placed][rank < k], at[placed][rank < k]
                            yield pa.RecordBatch.from_arrays([qids.take(pa.array(of)), ids.take(pa.array(at)), pa.array(away[of, at])], names=["qid", "id", "distance"])

    plain = chunks.filter(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(run, f"qid {kinds[1]}, id {kinds[0]}, distance double")


def dense(chunks: DataFrame, questions: DataFrame, k: int = POOL) -> DataFrame:
    """qid, id, distance, rank: cosine distance, nearest first, then id. chunks:
    id, embedding; questions: qid, vector. Vectors of another length are no neighbours.

    Blocks of questions, a stated set, meet blocks of chunks: a matrix product each, of
    which only the k best of each question leave the task."""
    spark = chunks.sparkSession
    kinds = [chunks.schema["id"].dataType.simpleString(), questions.schema["qid"].dataType.simpleString()]
    types = [arrow(x) for x in kinds]

    def blocks(parts: int) -> DataFrame:
        made = _blocks(questions.repartition(parts), QUESTIONS, "qid", "vector")
        return made.select(F.col("n").alias("qn"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("raw").alias("qraw"))

    few = blocks(max(1, MOST_BLOCKS // 2)).limit(MOST_BLOCKS + 1).collect()
    if len(few) <= MOST_BLOCKS:
        return best(_nearest(chunks, few, k, types, kinds), "qid", [F.col("distance"), F.col("id")], k)
    asked = blocks(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    pairs = _blocks(chunks, CHUNKS, "id", "embedding").join(asked, F.col("dim") == F.col("qdim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, dim, qn = (batch.column(c)[i].as_py() for c in ("n", "dim", "qn"))
                x = np.frombuffer(batch.column("raw")[i].as_buffer()).reshape(n, dim)
                q = np.frombuffer(batch.column("qraw")[i].as_buffer()).reshape(qn, dim)
                ids, qids = batch.column("ids")[i].values, batch.column("qids")[i].values
                away = _away(q, x)
                place = np.argsort(pc.rank(ids, tiebreaker="first").to_numpy(zero_copy_only=False))  # ids in order, so that a stable sort breaks ties
                best_ = place[np.argsort(away[:, place], axis=1, kind="stable")[:, :k]]
                rows = np.repeat(np.arange(qn), best_.shape[1])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(rows)).cast(types[1]), ids.take(pa.array(best_.ravel())).cast(types[0]), pa.array(away[rows, best_.ravel()])], names=["qid", "id", "distance"])

    scored = pairs.mapInArrow(run, f"qid {kinds[1]}, id {kinds[0]}, distance double")
    return best(scored, "qid", [F.col("distance"), F.col("id")], k)


#: Lexemes of questions that are broadcast; more are joined.
MOST_ASKED = 200_000
#: Pairs of a position and a question that are counted together, and that wait to be ranked.
PAIRS, WAITING = 2_000_000, 500_000
#: Changed lexemes that a task remembers, and bytes of texts that are counted together.
REMEMBERED, STEP = 500_000, 16_000_000


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a column of texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def tallied(batches: Iterator[pa.RecordBatch], known: list[str] | None = None, change: Callable[[str], str] | None = None) -> Iterator[tuple]:
    """ids, words, and in the order of words: which word, in which row, how often. batches: id, lower-case text.
    With `known` only those words; `change` is what becomes of a word."""
    wanted = None if known is None else pa.array(known, pa.string())
    changed = functools.lru_cache(REMEMBERED)(change) if change is not None else None
    for whole in batches:
        for batch in parts(whole, 1, STEP):
            lists = split_lexemes(batch.column(1))
            flat = lists.flatten().dictionary_encode()
            words, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            if changed is not None:
                again = pa.array([changed(x) for x in words.to_pylist()], pa.string()).dictionary_encode()
                words, code = again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
            if wanted is not None:
                code = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
                words, kept = wanted, code >= 0
            else:
                kept = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[code]
            found, n = np.unique(code[kept] * len(lists) + rows[kept], return_counts=True)
            yield batch.column(0), words, found // len(lists), found % len(lists), n.astype(np.int64)


def counted(chunks: DataFrame, known: list[str]) -> DataFrame:
    """id, word (number in known), n: the known lexemes of each row's text and how often it holds
    them, counted where the text is read, so that occurrences are not shuffled. chunks: id, text."""
    kind = chunks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, word, row, n in tallied(batches, known):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(word.astype(np.int32)), pa.array(n)], names=["id", "word", "n"])

    return chunks.select("id", F.lower("text").alias("text")).mapInArrow(run, f"id {kind}, word int, n long")


class Asked:
    """A bounded set of questions by their lexemes: words, and for each the questions that hold it."""

    def __init__(self, rows: list, kind):
        self.words = sorted({r.lexeme for r in rows})
        number = {w: i for i, w in enumerate(self.words)}
        self.qids = pa.array(list(dict.fromkeys(r.qid for r in rows)), kind)
        place = {q: i for i, q in enumerate(self.qids.to_pylist())}
        pairs = np.array(sorted({(number[r.lexeme], place[r.qid]) for r in rows}), np.int64).reshape(-1, 2)
        self.starts, self.questions = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1)), pairs[:, 1]


class Best:
    """The k positions of most hits of each question, of positions that come in the order of their ids."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k, self.seen = asked, k, 0
        self.least = np.zeros(len(asked.qids), np.int64)  # what a later position must have more of
        self.held: list[tuple] = []
        self.waiting = 0

    def add(self, ids: pa.Array, word: np.ndarray, n: np.ndarray) -> None:
        """Rows of positions that are complete, those of one position together."""
        if not len(ids):
            return
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        fan = self.asked.starts[word + 1] - self.asked.starts[word]
        sizes = np.cumsum(np.add.reduceat(fan, first))
        begin = 0
        while begin < len(first):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + PAIRS, "right")))
            self._count(ids, first, begin, end, word, n, fan)
            begin = end

    def _count(self, ids, first, begin, end, word, n, fan) -> None:
        rows = slice(first[begin], first[end] if end < len(first) else len(word))
        few, word, n = fan[rows], word[rows], n[rows]
        of = np.repeat(np.arange(end - begin), np.diff(np.append(first[begin:end], rows.stop)))
        each = np.repeat(np.arange(len(word)), few)
        question = self.asked.questions[self.asked.starts[word][each] + np.arange(len(each)) - np.repeat(np.cumsum(few) - few, few)]
        key, at = np.unique(of[each] * len(self.least) + question, return_inverse=True)
        hits = np.bincount(at, n[each]).astype(np.int64)
        of, question = np.divmod(key, max(len(self.least), 1))
        good = hits > self.least[question]
        of, question, hits = of[good], question[good], hits[good]
        self.held.append((question, hits, self.seen + of, ids.take(pa.array(first[begin:end][of]))))
        self.seen += end - begin
        self.waiting += len(of)
        if self.waiting > WAITING + self.k * len(self.least):
            self.prune()

    def prune(self) -> tuple:
        """The best so far: question, hits, place, ids."""
        if self.held:
            question, hits, place = (np.concatenate([h[i] for h in self.held]) for i in range(3))
            order = np.lexsort((place, -hits, question))
            starts = np.searchsorted(question[order], np.arange(len(self.least)))
            rank = np.arange(len(order)) - starts[question[order]]
            last = order[rank == self.k - 1]
            self.least[question[last]] = hits[last]
            order = order[rank < self.k]
            self.held = [(question[order], hits[order], place[order], pa.concat_arrays([h[3] for h in self.held]).take(pa.array(order)))]
            self.waiting = 0
        return self.held[0] if self.held else None


def top(held: DataFrame, asked: Asked, kinds: tuple[str, str], k: int) -> DataFrame:
    """qid, id, hits, rank. held: id, word (number in asked.words), n; kinds: types of qid and id.

    A position's rows meet in one task, which goes through them in the order of ids and
    keeps the k best of each question: neither memory nor what is shuffled grows with
    positions times questions."""
    shared = held.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = Best(shared.value, k), None
        for batch in batches:
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(code != code[-1])[-1] + 1) if len(code) and code[0] != code[-1] else 0  # the last position may go on
            done, rest = batch.slice(0, cut), batch.slice(cut)
            found.add(done.column(0), done.column(1).to_numpy(), done.column(2).to_numpy())
        if rest is not None:
            found.add(rest.column(0), rest.column(1).to_numpy(), rest.column(2).to_numpy())
        kept = found.prune()
        if kept is not None:
            yield pa.RecordBatch.from_arrays([shared.value.qids.take(pa.array(kept[0])), kept[3], pa.array(kept[1])], names=["qid", "id", "hits"])

    dealt = held.repartition("id").sortWithinPartitions("id")
    return best(dealt.mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, hits long"), "qid", [F.desc("hits"), F.col("id")], k)


def bounded(wanted: DataFrame) -> Asked | None:
    """The questions of wanted (qid, lexeme), if they hold at most MOST_ASKED lexemes."""
    rows = wanted.select("qid", "lexeme").limit(MOST_ASKED + 1).collect()
    return Asked(rows, arrow(wanted.schema["qid"].dataType.simpleString())) if len(rows) <= MOST_ASKED else None


def sparse(chunks: DataFrame, questions: DataFrame, k: int = POOL) -> DataFrame:
    """qid, id, hits, rank: the positions that hold any of the question's lexemes
    (but stop words), most first, then id. chunks: id, text; questions: qid,
    question. Only positions that some question asks for are counted and shuffled."""
    wanted = questions.select("qid", F.explode(asked(F.col("question"))).alias("lexeme"))
    few = bounded(wanted)
    if few is not None:
        return top(counted(chunks, few.words), few, (wanted.schema["qid"].dataType.simpleString(), chunks.schema["id"].dataType.simpleString()), k)
    posted = chunks.select("id", F.explode(lexemes(F.col("text"))).alias("lexeme")).join(wanted.select("lexeme").distinct(), "lexeme").groupBy("lexeme", "id").agg(F.count("*").alias("n"))
    hits = posted.join(wanted, "lexeme").groupBy("qid", "id").agg(F.sum("n").alias("hits"))
    return best(hits, "qid", [F.desc("hits"), F.col("id")], k)


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """qid, id, score, rank: reciprocal rank fusion. Ties go to the better rank
    in the last list, then in the ones before it, then to the id as text."""
    ranks = [f"r{i}" for i in range(len(lists))]
    # a full join, as a union of sides dealt by qid may take their partitions for one dealing
    fused = lists[0].select("qid", "id", F.col("rank").alias("r0"))
    for i, more in enumerate(lists[1:], 1):
        fused = fused.join(more.select("qid", "id", F.col("rank").alias(f"r{i}")), ["qid", "id"], "full")
    score = F.lit(0.0)
    for r in ranks:
        score = score + F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    fused = fused.withColumn("score", F.round(score, DIGITS))
    order = [F.desc("score"), *(F.asc_nulls_last(r) for r in reversed(ranks)), F.col("id").cast("string")]
    return best(fused, "qid", order, k)


def hybrid(texts: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = 10, pool: int = POOL) -> DataFrame:
    """texts: id, text; vectors: id, embedding (an id may be in one of them only);
    questions: qid, question, vector."""
    return fuse([dense(vectors, questions, pool), sparse(texts, questions, pool)], k)


def parents_of(ranked: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections of many questions' ranked chunks: (qid, n: from 1 in the order of the best
    chunk, anchor_id, document_id, heading_path), and each asked section's text once.
    ranked: qid, id, rank; chunks: id, document_id, heading_path, chunk_index, text."""
    section = ["document_id", "heading_path"]
    hits = ranked.select("qid", "id", "rank").join(chunks.select("id", *section), "id")
    anchors = hits.groupBy("qid", *section).agg(F.min(F.struct("rank", "id")).alias("best")).select("qid", *section, "best.rank", F.col("best.id").alias("anchor_id"))
    numbered = anchors.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).select("qid", "n", "anchor_id", *section)
    asked_for = numbered.select(*section).distinct()
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    texts = chunks.join(asked_for, section).groupBy(*section).agg(parts.alias("parts"))
    return numbered, texts.select(*section, F.array_join(F.transform("parts", lambda p: p.text), "\n\n").alias("text"))


def parents(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per section (document_id, heading_path) of the ranked chunks: the
    best-ranked chunk's id and rank, and the texts of all chunks of the section
    in order. ranked: id, rank; chunks: id, document_id, heading_path, chunk_index, text."""
    section = ["document_id", "heading_path"]
    hits = ranked.select("id", "rank").join(chunks.select("id", *section), "id")
    anchors = hits.groupBy(*section).agg(F.min(F.struct("rank", "id")).alias("best")).select(*section, "best.rank", F.col("best.id").alias("anchor_id"))
    siblings = chunks.join(anchors, section).groupBy(*section, "rank", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
    return siblings.select(*section, "rank", "anchor_id", F.array_join(F.transform("parts", lambda p: p.text), "\n\n").alias("text"))

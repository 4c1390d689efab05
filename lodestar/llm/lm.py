"""Language-model scoring by a hashed maximum-entropy model.

A word's probability has three factors: a softmax over 16 groups of classes, a
softmax over the group's 16 classes, and the word's smoothed share of its class.
The most frequent words are classes of their own; the others are classed by
their ending. The softmaxes have weights for hashed features of the context: the
word before, the two words before together (n-grams), and the second and third
word before (skips). The rows of features grow with the root of the training
tokens; an eighth as many of the most frequent words count as themselves in a
context, others by their ending. Weights are learnt by gradient steps (AdaGrad)
in every task over its own texts; what tasks changed is averaged, weights sharded,
round after round, each round over its share of the training texts, so that every
training text counts once. A task starts its own gradient sums, so weights depend
slightly on how rows fall into tasks. Counts of words cover all training texts.
Frequent words' counts are broadcast (at most FREQUENT of them); the rest are joined.

Defined cases: a null text is empty and has one token, its end; repeated rows
are scored and counted each; a null id is a training row; an empty table gives
an empty table; with no training text at all every word is unknown; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import groups, modest_batches, persist, raw_text
from lodestar.llm.lexicon import Lexicon, Table, mixed

#: Cannot be a word: words hold no white space.
END = b"\n"
GROUPS = 16
CLASSES = GROUPS * GROUPS
#: Words that are classes of their own.
SINGLE = CLASSES // 2
#: Least rows of hashed features, each with a weight for every group and class.
FEATURES = 4096
#: Rows of features for each word that counts as itself in a context.
ROWS_A_WORD = 8
#: Counts of words that are broadcast.
FREQUENT = 300_000
#: Rounds of averaged training, words of one gradient step, and words that are predicted together.
ROUNDS, STEP, BLOCK = 2, 65_536, 4096
RATE = 0.2
TEXT_STEP = 4_000_000
#: Weights that are averaged together.
SLICE = 32_768


def words(raw: bytes) -> list[bytes]:
    """ASCII letters lower-cased, cut at ASCII white space, and the end."""
    found = raw.lower().split()
    found.append(END)
    return found


def ending(word: bytes) -> int:
    """The class of a word that is not a class of its own."""
    stem = word.rstrip(b".,;:!?")
    return SINGLE + (hash_of(stem[-2:]) + 40 * (len(word) - len(stem))) % SINGLE


def hash_of(ending: bytes) -> int:
    return int.from_bytes(ending, "little") * 2654435761 % 4294967296 >> 12


def feature_rows(tokens: int) -> int:
    """A power of two near twice the root of the training tokens."""
    return max(FEATURES, 1 << round(float(np.log2(2 * max(tokens, 1) ** 0.5))))


def _count(docs: DataFrame) -> DataFrame:
    """hash, class, n: words of each task's texts, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, classes = Lexicon(), np.zeros(0, np.int16)
        counts = np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lexicon.hashes.view(np.int64)), pa.array(classes, pa.int32()), pa.array(counts)], names=["hash", "class", "n"])

        for batch in batches:
            for _, part in groups(batch.column("raw").to_pylist(), TEXT_STEP):
                if len(lexicon.numbers) > 300_000:
                    yield out()
                    lexicon.clear()
                    classes, counts = np.zeros(0, np.int16), np.zeros(0, np.int64)
                flat, _, new = lexicon.encode([words(raw) for raw in part])
                classes = np.concatenate([classes, np.array([ending(w) for w in new], np.int16)])
                met = np.bincount(flat, minlength=len(classes))
                met[: len(counts)] += counts
                counts = met
        if len(counts):
            yield out()

    return docs.select("raw").mapInArrow(run, "hash long, class int, n long").groupBy("hash", "class").agg(F.sum("n").alias("n"))


class Counts:
    """What is broadcast of the counts: frequent words and class totals."""

    def __init__(self, hashes, classes, n, single, totals, tokens, types):
        self.hashes, self.n = hashes, n
        self.classes = classes
        self.single, self.tokens, self.types = single, tokens, types
        self.features = feature_rows(tokens)
        self.mass, self.kinds = totals  # of each class: training tokens, types
        # within a class: (c + 0.5) / (mass + 0.5 * (kinds + 1)); nothing to tell for a class of one word
        self.within = np.log10(self.mass + 0.5 * (self.kinds + 1))
        prior = (self.mass + 0.5).reshape(GROUPS, GROUPS)
        self.bias_group = np.log(prior.sum(1) / prior.sum()).astype(np.float32)
        self.bias_class = np.log(prior / prior.sum(1, keepdims=True)).astype(np.float32)


def _counts(table: DataFrame) -> Counts:
    """table: hash, class, n."""
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least count at which no more than FREQUENT words are left
    steps = table.groupBy(F.least("n", F.lit(4096)).alias("n")).count().toPandas().sort_values("n", ascending=False)
    below = steps["count"].cumsum() <= FREQUENT
    least = int(steps["n"][below].min()) if below.any() else None
    if least is None and len(steps):  # more words than that have 4096 or more: the highest of them
        kept = table.orderBy(F.desc("n"), "hash").limit(FREQUENT).toPandas()
    else:
        kept = table.filter(F.col("n") >= (least or 0)).toPandas()
    kept = kept.sort_values(["n", "hash"], ascending=[False, True]).reset_index(drop=True)
    hashes = kept["hash"].to_numpy(np.int64).view(np.uint64)
    classes, n = kept["class"].to_numpy(np.int64), kept["n"].to_numpy(np.int64)
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():
        mass[r["class"]], kinds[r["class"]] = r.n, r.m
    single = min(SINGLE, len(hashes))
    for i in range(single):
        mass[classes[i]] -= n[i]
        kinds[classes[i]] -= 1
        classes[i] = i
        mass[i], kinds[i] = n[i], 1
    return Counts(hashes, classes, n, single, (mass, kinds), total[0], total[1])


class Reader:
    """Turns texts into classes and features, with the counts of frequent words."""

    def __init__(self, counts: Counts):
        self.counts, self.table, self.lexicon = counts, Table(counts.hashes), Lexicon()
        self.reset()

    def reset(self) -> None:
        self.classes, self.row, self.context = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def read(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and words of each text."""
        if self.lexicon.room():
            self.reset()
        known = len(self.classes)
        flat, sizes, new = self.lexicon.encode([words(raw) for raw in raws])
        row = self.table.find(self.lexicon.hashes[known:]).astype(np.int64)
        own = (row >= 0) & (row < self.counts.single)
        classes = np.array([ending(w) for w in new], np.int64)
        itself = (row >= 0) & (row < self.counts.features // ROWS_A_WORD)
        context = np.where(itself, self.lexicon.hashes[known:], classes.astype(np.uint64))
        classes[own] = row[own]
        self.classes, self.row = np.concatenate([self.classes, classes]), np.concatenate([self.row, row])
        self.context = np.concatenate([self.context, context])
        return flat, sizes

    def features(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of the hashed features, one column for each kind."""
        n, words = len(flat), self.context[flat]
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        back = []
        for k in (1, 2, 3):
            b = np.full(n, CLASSES, np.uint64)
            b[k:] = words[:-k] if n > k else words[:0]
            b[place < k] = CLASSES
            back.append(b)
        half = self.counts.features // 2
        kind = lambda i, b: (mixed(b + np.uint64(1000 * i)) % np.uint64(half)).astype(np.int64)
        both = (mixed(back[0], back[1]) % np.uint64(half)).astype(np.int64) + half
        return np.stack([kind(1, back[0]), both, kind(2, back[1]), kind(3, back[2])])


class Weights:
    def __init__(self, features: int, flat: np.ndarray | None = None):
        size = features * GROUPS
        self.flat = np.zeros(size + size * GROUPS, np.float32) if flat is None else flat.copy()
        self.group = self.flat[:size].reshape(features, GROUPS)
        self.inner = self.flat[size:].reshape(features * GROUPS, GROUPS)


ONES = np.ones((GROUPS, 1), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    np.minimum(x, 80, out=x)  # the exponential of more is beyond a float
    np.exp(x, out=x)
    x /= x @ ONES
    return x


def predicted(w: Weights, counts: Counts, features: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the groups, and of the classes of the given group."""
    a = w.group.take(features[0], 0)
    a += counts.bias_group
    b = w.inner.take(features[0] * GROUPS + group, 0)
    b += counts.bias_class.take(group, 0)
    for f in features[1:]:
        a += w.group.take(f, 0)
        b += w.inner.take(f * GROUPS + group, 0)
    return _softmax(a), _softmax(b)


def learn(w: Weights, seen: Weights, counts: Counts, features: np.ndarray, classes: np.ndarray) -> None:
    """One AdaGrad step on these words; seen: squared gradients so far. Only rows
    that these words touch are read and changed."""
    group, inner = np.divmod(classes, GROUPS)
    n = len(classes)
    a, b = np.empty((n, GROUPS), np.float32), np.empty((n, GROUPS), np.float32)
    for i in range(0, n, BLOCK):
        part = slice(i, i + BLOCK)
        a[part], b[part] = predicted(w, counts, features[:, part], group[part])
    each = np.arange(n)
    a[each, group] -= 1
    b[each, inner] -= 1
    for weights, squares, error, rows in ((w.group, seen.group, a, features), (w.inner, seen.inner, b, features * GROUPS + group)):
        touched = np.zeros(len(weights), bool)
        touched[rows.ravel()] = True
        at = np.flatnonzero(touched)
        place = np.empty(len(weights), np.int32)
        place[at] = np.arange(len(at), dtype=np.int32)
        rows = place[rows]
        slope = np.empty((len(at), GROUPS), np.float32)
        for j in range(GROUPS):
            column = error[:, j].astype(np.float64)
            slope[:, j] = sum(np.bincount(r, column, len(at)) for r in rows)
        past = squares[at] + slope * slope
        squares[at] = past
        weights[at] -= RATE * slope / np.sqrt(past + 1.0)


def _train_round(docs: DataFrame, shared, start: np.ndarray) -> np.ndarray:
    """The weights after each task's changes, averaged by the words they come from."""
    begin = docs.sparkSession.sparkContext.broadcast(start)
    cuts = range(0, len(start), SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(shared.value), 0
        w, seen = Weights(reader.counts.features, begin.value), Weights(reader.counts.features)
        for batch in batches:
            for _, part in groups(batch.column("raw").to_pylist(), TEXT_STEP):
                flat, sizes = reader.read(part)
                classes = reader.classes[flat]
                features = reader.features(flat, sizes)
                for i in range(0, len(classes), STEP):
                    learn(w, seen, reader.counts, features[:, i : i + STEP], classes[i : i + STEP])
                total += len(classes)
        if total:
            w.flat -= begin.value
            for i, at in enumerate(cuts):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "n": [float(total)], "change": [w.flat[at : at + SLICE].astype(np.float16).tobytes()]})

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for i, n, change in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist(), batch.column("change")):
                before, total = sums.get(i, (0.0, 0.0))
                sums[i] = before + n, total + n * np.frombuffer(change.as_buffer(), np.float16).astype(np.float64)
        for i, (n, total) in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "change": [(total / n).astype(np.float32).tobytes()]})

    changes = docs.select("raw").mapInArrow(run, "slice int, n double, change binary")
    final = changes.repartition("slice").mapInArrow(average, "slice int, change binary").collect()
    begin.unpersist()
    end = start.copy()
    for r in final:
        end[r.slice * SLICE : (r.slice + 1) * SLICE] += np.frombuffer(r.change, np.float32)
    return end


class Model:
    """What is learnt: all words' counts as a table, what is broadcast of them, the weights."""

    def __init__(self, table: DataFrame, counts: Counts, shared, weights: np.ndarray):
        self.table, self.counts, self.shared, self.weights = table, counts, shared, weights


def _read(docs: DataFrame, held_out) -> DataFrame:
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64("doc_id", "text").alias("key"), raw_text().alias("raw"))


def train(docs: DataFrame, held_out, rounds: int = ROUNDS) -> Model:
    """The model of the rows of docs that are not held out."""
    spark = docs.sparkSession
    modest_batches(spark)
    training = _read(docs, held_out).filter(~F.col("held_out"))
    table = persist(_count(training), "counts")
    counts = _counts(table)
    shared = spark.sparkContext.broadcast(counts)
    weights = Weights(counts.features).flat
    for i in range(rounds):
        weights = _train_round(training.filter(F.pmod(F.col("key"), F.lit(rounds)) == i), shared, weights)
    return Model(table, counts, shared, weights)


def score(docs: DataFrame, held_out, rounds: int = ROUNDS, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams
    with half a count added), score (this model): base-10 logarithms. docs:
    doc_id, text; held_out: a condition on them; those rows are not learnt from.
    model: one learnt before, instead of one learnt from docs."""
    model = model or train(docs, held_out, rounds)
    docs = _read(docs, held_out)
    table, counts, shared = model.table, model.counts, model.shared
    learnt = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        reader, w = Reader(counts), Weights(counts.features, learnt.value)
        for batch in batches:
            ids, held, keys = (batch.column(c) for c in ("doc_id", "held_out", "key"))
            for start, part in groups(batch.column("raw").to_pylist(), TEXT_STEP):
                flat, sizes = reader.read(part)
                classes, row = reader.classes[flat], reader.row[flat]
                features = reader.features(flat, sizes)
                context = np.empty(len(classes))
                for i in range(0, len(classes), BLOCK):
                    c = classes[i : i + BLOCK]
                    group, inner = np.divmod(c, GROUPS)
                    a, b = predicted(w, counts, features[:, i : i + BLOCK], group)
                    each = np.arange(len(c))
                    context[i : i + BLOCK] = np.log10(np.maximum(a[each, group], 1e-30)) + np.log10(np.maximum(b[each, inner], 1e-30))
                known = row >= 0
                log_c = np.zeros(len(row))
                log_c[known] = np.log10(counts.n[row[known]] + 0.5)
                own = known & (row < counts.single)
                of = np.repeat(np.arange(len(part)), sizes)
                total = lambda x: np.bincount(of, x, len(part))
                here = slice(start, start + len(part))
                m = len(part)
                yield pa.RecordBatch.from_arrays([
                    ids[here], keys[here], held[here], pa.array(np.ones(m, np.int64)), pa.array(sizes), pa.array(total(known).astype(np.int64)),
                    pa.array(total(log_c)), pa.array(total(context + np.where(own, 0.0, log_c - counts.within[classes]))),
                    pa.nulls(m, pa.int64()), pa.array(np.zeros(m, np.int64)),
                ], names=names)
                # words that are not frequent: their counts are joined
                pair = (of[~known].astype(np.int64) << 32) | flat[~known]
                pair, times = np.unique(pair, return_counts=True)
                at = pa.array((pair >> 32) + start)
                m = len(pair)
                yield pa.RecordBatch.from_arrays([
                    ids.take(at), keys.take(at), held.take(at), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int64)),
                    pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m)), pa.array(np.zeros(m)),
                    pa.array(reader.lexicon.hashes[pair & 0xFFFFFFFF].view(np.int64)), pa.array(times.astype(np.int64)),
                ], names=names)

    names = ["doc_id", "key", "held_out", "rows", "n_tokens", "n_known", "logs", "score", "hash", "times"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = persist(docs.mapInArrow(run, f"doc_id {kind}, key long, held_out boolean, rows long, n_tokens long, n_known long, logs double, score double, hash long, times long"), "scored")
    rare = made.filter("hash IS NOT NULL").join(table.select("hash", "n"), "hash", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    added = rare.select(
        "doc_id", "key", "held_out", "rows", "n_tokens", F.when(F.col("n") > 0, F.col("times")).otherwise(F.lit(0)).alias("n_known"),
        log.alias("logs"), log.alias("score"),
    )
    whole = made.filter("hash IS NULL").select(*added.columns).unionByName(added)
    sums = whole.groupBy("doc_id", "key", "held_out").agg(*(F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "logs", "score")))
    one = lambda c: (F.col(c) / F.col("rows")).alias(c)  # noqa: E731  rows with one id and text are summed together
    least = float(np.log10(counts.tokens + 0.5 * (counts.types + 1)))
    each = sums.select("doc_id", "held_out", *map(one, ("n_tokens", "n_known", "logs", "score")), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return each.select(
        "doc_id", "held_out", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(least)).alias("base_score"), "score",
    )

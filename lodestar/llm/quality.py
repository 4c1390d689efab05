"""Quality classifier: perplexity under a language model of trusted text.

The model is an interpolated modified Kneser-Ney trigram model over words. The ids
fall into two halves by a hash. Each half's model counts all documents of the half
that the labels call good, and scores all documents of the other half, so that no
document is scored by a model that has seen it, and every trusted document both
trains a model and sets the limits.

Every word, with the two before it, goes to the shard of the middle one, as packed
columns. A shard holds all that a word's trigrams, its bigrams and the contexts of both
add up to, and how many words come before it. First the labelled documents go there
to be counted: the counts of counts give the discounts, and the words' own counts go
to the shards, broadcast while there are at most BROADCAST_WORDS, joined to the words
that each shard asks for otherwise. Then all documents go there, to the shards of one
turn after the other so that less is on disk at once, and each shard gives its sums of
the words' log probabilities by document.

A few bad words hardly move the mean that a perplexity is. So all documents labelled
as bad give a second model, of words alone, by the same halves, and a document's
contrast is the greatest log10 ratio of the probability among bad text to that among
trusted text, of its words that bad text has.

A document is kept while its perplexity is at most MARGIN times the `quantile`
of its language's trusted documents, and while its contrast is at most their
`quantile` plus APART; languages with fewer than LEAST_TRUSTED of them share the
quantiles of all.

Defined cases: a null text is empty; a text without words has neither perplexity
nor contrast (null) and is kept; a null language is a language; labels of absent
documents, repeated labels and null labels are harmless (a document is trusted if
any label says so and none says otherwise, bad if any label says so); a document
whose other half has no trusted text is kept, with null perplexity; without bad text
no document has a contrast; repeated rows are scored each; an empty table gives an
empty table; columns named perplexity, contrast, limit or keep are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import forget, is_small, modest_batches, modest_bytes, parts, persist, raw_text, release
from lodestar.llm.lexicon import Table, mixed, word_hashes

#: Words' counts that are broadcast, bytes of them that pass the driver together.
BROADCAST_WORDS, PIECE = 12_000_000, 4_000_000
#: Labels that are broadcast.
BROADCAST_LABELS = 1_000_000
#: Bytes of text for which there is a shard, and shards at least.
SHARD, LEAST_SHARDS = 18_000_000, 24
#: Turns in which the shards take all documents; each reads all texts.
TURNS = 4
QUANTILE, MARGIN, APART, LEAST_TRUSTED = 0.99, 1.15, 0.3, 30
#: The numbers and hashes of what stands before, at and after the end of a text.
MARKS = np.array([1, 2, 3], np.uint64)
START, END, NOTHING = range(3)
#: Bytes of texts cut together; places that a task packs together.
TEXT_STEP, PLACES = 1_000_000, 2_500_000
#: What a text is used for.
GOOD, BAD, SCORED = 1, 2, 4


def packed(**columns: np.ndarray) -> bytes:
    """Columns of any lengths as one value: the first bytes of all numbers, then the second ones
    and so on, compressed."""
    made = {}
    for name, a in columns.items():
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).ravel() if len(a) else np.zeros(0, np.uint8)
        made[f"{name}:{a.dtype.str}"] = pa.ListArray.from_arrays(pa.array([0, len(planes)], pa.int32()), pa.array(planes))
    batch = pa.record_batch(made)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes | pa.Buffer) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(value).read_next_batch()
    out = {}
    for i, field in enumerate(batch.schema.names):
        name, kind = field.split(":")
        planes = batch.column(i).values.to_numpy()
        out[name] = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if len(planes) else np.zeros(0, kind)
    return out


def values(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
    """The packed values of a shard, one after the other."""
    for value in table.column("packed"):
        a = unpacked(value.as_buffer())
        a["words"] = np.cumsum(a["words"], dtype=np.uint64)
        yield a


def _places(texts: DataFrame, shards: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """shard, packed, by the shard of the middle word, for each turns-th shard. texts: key, half, use, raw.
    packed: words (hashes, each less the one before); u, v, w (numbers of words) for every word and
    end of a text and the two before it, and, with nothing as w, for its end and the one before; size
    (places of each document), key, half, use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            hashes, sizes, key, half, use = map(np.concatenate, zip(*held))
            held.clear()
            found = pa.array(hashes).dictionary_encode()
            flat, hashes = found.indices.to_numpy(), np.concatenate([MARKS, found.dictionary.to_numpy()])
            ends = np.cumsum(sizes + 4)  # each text stands between two starts, an end and nothing
            n = np.full(int(ends[-1]), START, np.int32)
            inner = np.ones(len(n), bool)
            inner[ends - sizes - 4] = inner[ends - sizes - 3] = False
            at = np.flatnonzero(inner)
            inner[ends - 2] = inner[ends - 1] = False
            n[inner] = flat + len(MARKS)
            n[ends - 2], n[ends - 1] = END, NOTHING
            shard = (mixed(hashes) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int32)[n[at - 1]]
            mine = np.flatnonzero(shard % turns == turn)
            order = mine[np.argsort(shard[mine], kind="stable")]
            shard, at = shard[order], at[order]
            of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)[order]
            uvw = n[at - 2], n[at - 1], n[at]
            number = np.empty(len(hashes), np.int32)
            those = np.arange(turn, shards, turns)
            rows, told = [], []
            for s, a, b in zip(those, *(np.searchsorted(shard, those, side) for side in ("left", "right"))):
                if a == b:
                    continue
                own = [x[a:b] for x in uvw]
                if 20 * (b - a) < len(hashes):  # among many shards, so that none costs all words
                    words, times = np.unique(np.concatenate(own), return_counts=True)
                else:
                    times = sum(np.bincount(x, minlength=len(hashes)) for x in own)
                    words = np.flatnonzero(times)
                    times = times[words]
                # the frequent ones first, equals by hash: both keep the numbers short
                words = words[np.lexsort((hashes[words], -times))]
                number[words] = np.arange(len(words), dtype=np.int32)
                of_docs = np.bincount(of[a:b], minlength=len(sizes))
                doc = np.flatnonzero(of_docs)
                columns = {c: number[x] for c, x in zip("uvw", own)}
                rows.append(packed(words=np.diff(hashes[words], prepend=np.uint64(0)), **columns, size=of_docs[doc].astype(np.int32), key=key[doc], half=half[doc], use=use[doc]))
                told.append(s)
            return pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), pa.array(rows, pa.binary())], names=["shard", "packed"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "half", "use")]
            for start, part in parts(batch.column("raw"), TEXT_STEP):
                if size > PLACES:
                    yield out()
                    size = 0
                hashes, sizes = word_hashes(part)
                held.append((hashes, sizes, *(c[start : start + len(part)] for c in columns)))
                size += len(hashes) + 2 * len(part)
        if held:
            yield out()
        pa.default_memory_pool().release_unused()

    return texts.select("key", "half", "use", "raw").mapInArrow(run, "shard int, packed binary")


def _grams(a: dict[str, np.ndarray], use: int, half: int, names: tuple[str, ...], others: bool = False, beyond: bool = False) -> dict[str, np.ndarray]:
    """Of the places of this half's documents, or of the others', with this use: the document's
    number (of), what v and w are (first, full, end), and the hashes, by the half, of u and v (uv),
    and so on. beyond: also with nothing as w."""
    words, docs = a["words"], ((a["use"] & use) > 0) & ((a["half"] == half) != others)
    mark = lambda c, i, at: np.isin(a[c][at], np.flatnonzero(words == MARKS[i]))
    at = np.flatnonzero(np.repeat(docs, a["size"]))
    if not beyond:
        at = at[~mark("w", NOTHING, at)]
    u, v, w = (a[c][at] for c in "uvw")
    own = mixed(np.full(len(words), half, np.uint64), words)
    uv = mixed(words[v], start=own[u])
    made = {
        "of": lambda: np.repeat(np.arange(len(docs)), a["size"])[at],
        "first": lambda: mark("v", START, at),
        "full": lambda: ~mark("w", NOTHING, at),
        "end": lambda: mark("w", END, at),
        "v": lambda: own[v],
        "w": lambda: own[w],
        "uv": lambda: uv,
        "vw": lambda: mixed(words[w], start=own[v]),
        "uvw": lambda: mixed(words[w], start=uv),
    }
    return {c: made[c]() for c in names}


def _all(parts: list[dict[str, np.ndarray]], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The columns of all parts, which lose them."""
    return {c: np.concatenate([np.zeros(0, bool if c == "first" else np.uint64), *(p.pop(c) for p in parts)]) for c in names}


def _classes(n: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """How many of each context came 1, 2, 3 or more times."""
    return np.stack([np.bincount(of, c, rows) for c in (n == 1, n == 2, n >= 3)])


#: What a model is made of.
FULL, BEFORE = ("uvw", "uv", "vw", "v"), ("uv", "v", "first")


class Shard:
    """What one half's trusted texts' places of one shard add up to, each distinct gram once:
    n of uvw; total, c (1, 2, 3 or more) of the context uv; n2 (words before) of vw; total2, b of the context v."""

    def __init__(self, parts: list[dict[str, np.ndarray]]):
        g = _all(parts, FULL)
        self.uvw, at, self.n = np.unique(g.pop("uvw"), return_index=True, return_counts=True)
        uv, vw, v = (g.pop(c)[at] for c in ("uv", "vw", "v"))
        self.uv, self.uv_of = np.unique(uv, return_inverse=True)
        self.total, self.c = np.bincount(self.uv_of, self.n, len(self.uv)), _classes(self.n, self.uv_of, len(self.uv))
        self.vw, at, self.n2 = np.unique(vw, return_index=True, return_counts=True)
        self.v, self.v_of = np.unique(v[at], return_inverse=True)
        self.total2, self.b = np.bincount(self.v_of, self.n2, len(self.v)), _classes(self.n2, self.v_of, len(self.v))

    def counts_of_counts(self) -> np.ndarray:
        """order (trigrams, bigrams), count (1 to 4)."""
        return np.array([[(n == i).sum() for i in (1, 2, 3, 4)] for n in (self.n, self.n2)])

    def prepare(self, d3: np.ndarray, d2: np.ndarray) -> None:
        """Of discounts: the tables that places are looked up in, with a last row for what is not there."""
        own = lambda n, of, total, d: np.append((n - d[np.minimum(n, 3) - 1]) / total[of], 0.0)
        rest = lambda classes, total, d: np.append((d[:, None] * classes).sum(axis=0) / total, 1.0)
        self.tables = {
            "uvw": (Table(self.uvw), own(self.n, self.uv_of, self.total, d3)),
            "uv": (Table(self.uv), rest(self.c, self.total, d3)),
            "vw": (Table(self.vw), own(self.n2, self.v_of, self.total2, d2)),
            "v": (Table(self.v), rest(self.b, self.total2, d2)),
        }
        del self.n, self.uv_of, self.total, self.c, self.n2, self.v_of, self.total2, self.b

    def probabilities(self, g: dict[str, np.ndarray], p1: np.ndarray) -> np.ndarray:
        uvw, uv, vw, v = (values[table.find(g[c])] for c, (table, values) in self.tables.items())
        return uvw + uv * (vw + v * p1)


def _distinct(parts: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words, and how many words come before each."""
    g = _all(parts, BEFORE)
    _, at = np.unique(g.pop("uv"), return_index=True)
    at = at[~g["first"][at]]
    return np.unique(g["v"][at], return_counts=True)


def _count(table: pa.Table) -> pa.Table:
    """Of one shard: gram, half, n1, bad: the words and how many trusted and bad words
    come before them. The counts of counts are rows of no half (2)."""
    rows = []
    for half in (0, 1):  # one after the other, so that the places of one are held
        full, good, bad = [], [], []
        for a in values(table):
            g = _grams(a, GOOD, half, (*FULL, "first", "full"), beyond=True)
            full.append({c: g[c][g["full"]] for c in FULL})
            good.append({c: g[c] for c in BEFORE})
            bad.append(_grams(a, BAD, half, BEFORE, beyond=True))
        told = Shard(full).counts_of_counts().ravel()
        (w, n1), (z, n0) = _distinct(good), _distinct(bad)
        none = lambda n: np.zeros(n, np.int64)
        rows.append((w, np.full(len(w), half), n1, none(len(w))))
        rows.append((z, np.full(len(z), half), none(len(z)), n0))
        rows.append((np.arange(len(told), dtype=np.uint64) + np.uint64(half * len(told)), np.full(len(told), 2), told, none(len(told))))
    gram, half, n1, bad = map(np.concatenate, zip(*rows))
    pa.default_memory_pool().release_unused()
    return pa.table({"gram": gram.view(np.int64), "half": half.astype(np.int32), "n1": n1, "bad": bad})


def _discounts(found: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more; found: how many counts are 1, 2, 3, 4."""
    if not all(found):
        return [0.5, 0.75, 0.9]
    y = found[0] / (found[0] + 2 * found[1])
    return [min(max(i + 1 - (i + 2) * y * found[i + 1] / found[i], 0.0), i + 1.0) for i in range(3)]


@dataclass
class Unigrams:
    """By half: discounts of words' counts, their sum, what is left for each other word, and whether there are words."""

    d: np.ndarray
    total: np.ndarray
    even: np.ndarray
    some: np.ndarray

    @staticmethod
    def of(counts: dict[int, list[int]]) -> Unigrams:
        """counts: by half, how many counts are 1, 2, 3, 4, how many at least 3, how many words, their sum."""
        d, total, even, some = np.zeros((2, 3)), np.ones(2), np.zeros(2), np.zeros(2, bool)
        for half, (*r, more, words, s) in counts.items():
            if words:
                d[half], total[half], some[half] = _discounts(r), s, True
                even[half] = float(d[half] @ [*r[:2], more]) / s / (words + 1)
        return Unigrams(d, total, even, some)

    def p(self, n: np.ndarray, half: int) -> np.ndarray:
        own = np.where(n > 0, (n - self.d[half, np.clip(n, 1, 3) - 1]) / self.total[half], 0.0)
        return np.maximum(own + self.even[half], 1e-30)


class Words:
    """The words' counts, to look probabilities up in."""

    def __init__(self, gram: np.ndarray, n1: np.ndarray, bad: np.ndarray):
        self.table = Table(gram.view(np.uint64))
        self.n1, self.bad = np.append(n1, n1.dtype.type(0)), np.append(bad, bad.dtype.type(0))

    @staticmethod
    def of(shared: list) -> Words:
        """From pieces that were broadcast."""
        pieces = [unpacked(value) for piece in shared for value in piece.value]
        kinds = {"gram": np.int64, "n1": np.int32, "bad": np.int32}
        return Words(*(np.concatenate([np.zeros(0, kind), *(p.pop(c) for p in pieces)]) for c, kind in kinds.items()))

    def find(self, w: np.ndarray, half: int, good: Unigrams, bad: Unigrams) -> tuple[np.ndarray, np.ndarray]:
        """Probability among trusted text, and contrast (nan: not among bad text)."""
        at = self.table.find(w)
        p1, n, apart = good.p(self.n1[at], half), self.bad[at], np.full(len(w), np.nan)
        told = np.flatnonzero(n)
        apart[told] = np.log10(bad.p(n[told], half)) - np.log10(p1[told])
        return p1, apart


def _pieces(words: DataFrame) -> list:
    """The words' counts, broadcast piece by piece: the driver holds one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy().astype(kind) for c, kind in (("gram", np.int64), ("n1", np.int32), ("bad", np.int32))}
            yield pa.RecordBatch.from_arrays([pa.array([packed(**columns)], pa.binary())], names=["packed"])

    shared, held, size = [], [], 0
    context = words.sparkSession.sparkContext
    for (value,) in words.select("gram", "n1", "bad").mapInArrow(run, "packed binary").toLocalIterator():  # a job for each file
        held.append(bytes(value))
        size += len(value)
        if size >= PIECE:
            shared.append(context.broadcast(held))
            held, size = [], 0
    return [*shared, context.broadcast(held)]


def _asked(places: DataFrame, words: DataFrame) -> DataFrame:
    """shard, gram, n1, bad: the counts of the words that each shard scores, for any number of words."""

    def run(table: pa.Table) -> pa.Table:
        seen = np.unique(np.concatenate([np.unique(_grams(a, SCORED, half, ("w",), others=True)["w"]) for a in values(table) for half in (0, 1)]))
        return pa.table({"shard": np.full(len(seen), table.column("shard")[0].as_py(), np.int32), "gram": seen.view(np.int64)})

    asked = places.groupBy("shard").applyInArrow(run, "shard int, gram long")
    return asked.join(words.hint("merge"), "gram").select("shard", "gram", "n1", "bad")


def _scores(texts: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """key, perplexity, contrast of the texts that are SCORED, each by the model of the other half."""
    spark = texts.sparkSession
    modest_bytes(spark)
    size = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    shards = TURNS * math.ceil(max(LEAST_SHARDS, size / SHARD) / TURNS)
    labelled = _places(texts.filter(F.col("use") != SCORED), shards)
    counted = persist(labelled.groupBy("shard").applyInArrow(_count, "gram long, half int, n1 long, bad long"), "counts")
    del labelled
    told = {r.gram: r.n for r in counted.filter("half = 2").groupBy("gram").agg(F.sum("n1").alias("n")).collect()}
    d3, d2 = (np.array([_discounts([told.get((half * 2 + order) * 4 + i, 0) for i in range(4)]) for half in (0, 1)]) for order in (0, 1))
    rows = counted.filter("half < 2")
    # a word among both trusted and bad text is two rows, both of its shard's file
    words = persist(rows.groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("bad").alias("bad")), "words")

    def unigrams(c: str) -> Unigrams:
        classes = [F.count(F.when(F.col(c) == i, 1)) for i in (1, 2, 3, 4)]
        found = rows.groupBy("half").agg(*classes, F.count(F.when(F.col(c) >= 3, 1)), F.count(F.when(F.col(c) > 0, 1)), F.sum(c)).collect()
        return Unigrams.of({r[0]: list(r[1:]) for r in found})

    good, bad = unigrams("n1"), unigrams("bad")
    if broadcast is None:
        broadcast = is_small(words, BROADCAST_WORDS)
    shared = _pieces(words) if broadcast else []
    forget(counted, *([words] if broadcast else []))

    columns = "key long, logs double, n int, ends int, apart float"

    def summed(table: pa.Table, known: Words) -> pa.Table:
        found = []
        for half in (0, 1):  # one model after the other
            shard = Shard([_grams(a, GOOD, half, FULL) for a in values(table)])
            shard.prepare(d3[half], d2[half])
            for a in values(table):
                g = _grams(a, SCORED, half, (*FULL, "w", "of", "end"), others=True)
                n = np.bincount(g["of"], minlength=1)
                docs = np.flatnonzero(n)
                if not len(docs):
                    continue
                n = n[docs]
                p1, apart = known.find(g["w"], half, good, bad)
                logs = np.log10(np.maximum(shard.probabilities(g, p1), 1e-30))
                if not good.some[half]:
                    logs[:] = np.nan
                starts = np.cumsum(n) - n
                ends = np.add.reduceat(g["end"].astype(np.int32), starts)
                found.append((a["key"][docs], np.add.reduceat(logs, starts), n.astype(np.int32), ends, np.fmax.reduceat(apart, starts).astype(np.float32)))
            del shard
        pa.default_memory_pool().release_unused()
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float32())
        whole = map(np.concatenate, zip(*found)) if found else ((),) * len(kinds)
        return pa.table([pa.array(x, kind, from_pandas=True) for x, kind in zip(whole, kinds)], names=[c.split()[0] for c in columns.split(", ")])

    def taken(turn: int) -> DataFrame:
        places = _places(texts, shards, turn, TURNS)
        if broadcast:
            return places.groupBy("shard").applyInArrow(lambda table: summed(table, Words.of(shared)), columns)
        told = lambda words: Words(*(words.column(c).to_numpy() for c in ("gram", "n1", "bad")))
        asked = _asked(places, words).groupBy("shard")
        return asked.cogroup(places.groupBy("shard")).applyInArrow(lambda words, table: summed(table, told(words)), columns)

    # sums of shards are added up turn by turn, so that few of them are on disk
    add = lambda df: df.groupBy("key").agg(*(f(c).alias(c) for f, c in ((F.sum, "logs"), (F.sum, "n"), (F.sum, "ends"), (F.max, "apart"))))
    made = []
    for turn in range(TURNS):
        release(spark)
        made.append(persist(add(taken(turn)), "sums"))
    release(spark)
    sums = add(reduce(DataFrame.unionByName, made))
    some = F.col("n") > F.col("ends")  # rows that share a key have a multiple of both
    per, apart = F.pow(F.lit(10.0), -F.col("logs") / F.col("n")), F.col("apart").cast("double")
    scores = persist(sums.select("key", F.when(some, per).alias("perplexity"), F.when(some & F.col("logs").isNotNull(), apart).alias("contrast")), "scores")
    forget(*([] if broadcast else [words]), *made)
    return scores


def train(docs: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """What score() learns from: all of docs, and of bad for the contrast. docs, bad: raw."""
    use = lambda df, kind: df.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("half"), F.lit(kind).alias("use"), F.coalesce("raw", F.lit(b"")).alias("raw"))
    return use(docs, GOOD) if bad is None else use(docs, GOOD).unionByName(use(bad, BAD))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs with a key that rows of one id and text share."""
    return docs.withColumn("__key", F.xxhash64(*(["doc_id"] if "doc_id" in docs.columns else []), text))


def _with(docs: DataFrame, scores: DataFrame, text: str, keep_text: bool) -> DataFrame:
    names = [c for c in docs.columns if c not in ("perplexity", "contrast") and (keep_text or c != text)]
    # both sides grow with the corpus, so none is broadcast
    return _keyed(docs, text).join(scores.withColumnRenamed("key", "__key").hint("merge"), "__key", "left").select(*names, "perplexity", "contrast")


def score(docs: DataFrame, model: DataFrame, text: str = "text", broadcast: bool | None = None, keep_text: bool = True) -> DataFrame:
    """docs with perplexity and contrast; null where the model (of train) is empty.
    broadcast: whether the words' counts are, or are joined (None: by their number)."""
    asked = _keyed(docs, text).select(F.col("__key").alias("key"), F.lit(1).alias("half"), F.lit(SCORED).alias("use"), raw_text(text).alias("raw"))
    return _with(docs, _scores(model.unionByName(asked), broadcast), text, keep_text)


def labels_of(labels: DataFrame) -> DataFrame:
    """__id, good (trusted) and bad of each labelled document."""
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(
        ((F.min(F.coalesce("quality", F.lit(0))) == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good"),
        ((F.min("quality") == 0) | (F.max("toxic") == 1)).alias("bad"),
    )


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, keep_text: bool = True) -> DataFrame:
    """docs with perplexity, contrast, limit (of the language's perplexity) and keep."""
    modest_batches(docs.sparkSession)
    docs = docs.drop("perplexity", "contrast", "limit", "keep")
    told = persist(labels_of(labels), "labelled")
    told = F.broadcast(told) if is_small(told, BROADCAST_LABELS) else told
    of = lambda df: df.join(told, F.col("doc_id") == F.col("__id"), "left")
    use = sum((F.when(F.col(c), kind).otherwise(0) for c, kind in (("good", GOOD), ("bad", BAD))), F.lit(SCORED))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    texts = of(_keyed(docs, "text")).select(F.col("__key").alias("key"), half.alias("half"), use.alias("use"), raw_text().alias("raw"))
    scores = _scores(texts)
    scored = _with(docs, scores, "text", keep_text)
    trusted = of(_with(docs, scores, "text", False)).filter("good AND perplexity IS NOT NULL")
    trusted = persist(trusted.select("lang", "perplexity", "contrast"), "trusted")
    at = lambda c, q: F.percentile_approx(c, q, 10_000)
    marks = {"__high": at("perplexity", quantile), "__apart": at("contrast", quantile)}
    limits = trusted.groupBy(F.col("lang").alias("__lang")).agg(*(c.alias(name) for name, c in marks.items()), F.count("*").alias("n"))
    overall = trusted.agg(*(c.alias(name) for name, c in marks.items())).first()
    limits = persist(limits.filter(F.col("n") >= LEAST_TRUSTED).drop("n"), "limits")
    few = is_small(limits, 10_000)
    joined = scored.join(F.broadcast(limits) if few else limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    high, apart = (F.coalesce(name, F.lit(overall[name]).cast("double")) for name in marks)
    limit = high * F.lit(margin)
    good = (F.col("perplexity") <= limit) & F.coalesce(F.col("contrast") <= apart + APART, F.lit(True))
    return joined.select(*scored.columns, limit.alias("limit"), F.coalesce(good, F.lit(True)).alias("keep"))

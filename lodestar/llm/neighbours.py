"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Vectors are dealt into shards of about `SHARD` rows by a hash of their id. A
component that makes all vectors equally long turns the largest inner product into
the smallest distance. In a shard, a vector's level is drawn from a hash of its id, and
each level has a graph of its vectors, kept as one flat array of neighbour numbers
(rows of equal length, -1 for none). Levels are built from the top; vectors enter a
level in blocks: a beam search in the graph so far, started where the levels above
lead, and the rest of the block propose neighbours, of which those stay that are
nearer to the vector than to any neighbour already chosen. A search descends
greedily and ends with a beam on the lowest level; all vectors of a block move in
step in numpy. Scores are inner products in double precision of the original
vectors, and shards' results are merged.

An index is one row a shard and lies in the shared folder. Each query visits every
shard: an index stays in its task and queries stream past it, so what moves is the
index once and queries x shards.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components
take no part, nor do null ids; vectors of another number of components than the query's
are no candidates of it; equal vectors of a shard are one point of the graph with
all its ids, of which the smallest come first; rows that repeat an id are candidates
each, but not of a query with that id; a query with fewer than k candidates gets all
that are found; ties go to the smaller id; an empty table gives an empty table; a
shard of at most `ef` points is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import persist

#: Vectors of a shard, about.
SHARD = 4096
#: Neighbours of a point on the lowest level; half as many above.
LINKS = 32
#: Width of the beam while building and while searching.
BUILD_EF, SEARCH_EF = 64, 128
#: Vectors that move in step, and candidates that each expands at a time.
BLOCK, WIDE = 512, 4


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    return table.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select("vec_id", x.cast("array<double>").alias("vector"))


def levels(ids: np.ndarray, links: int) -> np.ndarray:
    """A level for each id, geometric with ratio links / 2, from a hash of it."""
    x = (ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    uniform = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.floor(-np.log(uniform) / np.log(links / 2)).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def beam(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the (up to) ef points met that are nearest, in order, and their
    distances; -1 and infinity fill the rest."""
    n, width = len(queries), graph.shape[1]
    ids = np.full((n, ef), -1, np.int32)
    away = np.full((n, ef), np.inf, np.float32)
    open_ = np.zeros((n, ef), np.bool_)
    ids[:, 0] = entries
    away[:, 0] = _distances(points[entries], queries)
    open_[:, 0] = True
    seen = np.zeros((n, len(points) + 1), np.bool_)  # the last column takes what is no point
    seen[np.arange(n), entries] = True
    live = np.arange(n)
    while len(live):
        ready = open_[live]
        picks = np.argsort(~ready, axis=1, kind="stable")[:, : min(WIDE, ef)]  # the nearest that are open
        good = np.take_along_axis(ready, picks, 1)
        chosen = np.where(good, np.take_along_axis(ids[live], picks, 1), -1)
        open_[live[:, None], picks] = False
        near = np.where(chosen[:, :, None] >= 0, graph[chosen], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)  # what two of them name stands side by side
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = ~seen[live[:, None], near] & (near >= 0)
        seen[live[:, None], near] = True
        rows, columns = np.nonzero(fresh)
        new = np.full(near.shape, np.inf, np.float32)
        new[rows, columns] = _distances(points[near[rows, columns]], queries[live[rows]])
        # what is farther than the beam's last cannot enter
        both_away = np.concatenate([away[live], new], 1)
        order = np.argpartition(both_away, ef - 1, axis=1)[:, :ef] if both_away.shape[1] > ef else np.broadcast_to(np.arange(ef), (len(live), ef))
        cut = np.take_along_axis(both_away, order, 1)
        order = np.take_along_axis(order, np.argsort(cut, axis=1, kind="stable"), 1)
        away[live] = np.take_along_axis(both_away, order, 1)
        found = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
        ids[live] = np.where(np.isfinite(away[live]), found, -1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], 1), order, 1)
        live = live[open_[live].any(1)]
    return ids, away


def chosen(points: np.ndarray, of: np.ndarray, ids: np.ndarray, away: np.ndarray, links: int) -> np.ndarray:
    """Up to `links` of each row's candidates (in order of distance): those nearer to the
    row's point than to all chosen before, then, where places are free, the nearest others."""
    n, many = ids.shape
    own = points[np.maximum(ids, 0)]
    norms = np.einsum("nij,nij->ni", own, own)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (own @ own.transpose(0, 2, 1))
    usable_ = (ids >= 0) & (ids != of[:, None])
    usable_[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    taken = np.zeros((n, many), np.bool_)
    blocked = np.zeros((n, many), np.bool_)
    count = np.zeros(n, np.int64)
    for i in range(many):
        take = usable_[:, i] & ~blocked[:, i] & (count < links)
        taken[:, i] = take
        count += take
        blocked |= take[:, None] & (between[:, i] < away)
    rank = np.where(taken, 0, np.where(usable_, 1, 2)) * many + np.arange(many)
    order = np.argsort(rank, axis=1)[:, :links]
    fine = np.take_along_axis(usable_, order, 1)
    out = np.full((n, links), -1, np.int32)
    out[:, : order.shape[1]] = np.where(fine, np.take_along_axis(ids, order, 1), -1)
    return out


def _linked_back(points: np.ndarray, graph: np.ndarray, sources: np.ndarray) -> None:
    """Adds the sources to their neighbours' rows; a row that overflows chooses anew."""
    links = graph.shape[1]
    source = np.repeat(sources, links)
    target = graph[sources].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rows, first, counts = np.unique(target, return_index=True, return_counts=True)
    for start in range(0, len(rows), BLOCK):
        part, begins, many = rows[start : start + BLOCK], first[start : start + BLOCK], counts[start : start + BLOCK]
        wide = int(many.max())
        more = np.full((len(part), wide), -1, np.int32)
        at = np.arange(wide)[None, :]
        inside = at < many[:, None]
        more[inside] = source[(begins[:, None] + at)[inside]]
        ids = np.concatenate([graph[part], more], 1)
        away = np.where(ids >= 0, _distances(points[np.maximum(ids, 0)], points[part][:, None, :]), np.inf).astype(np.float32)
        order = np.argsort(away, axis=1, kind="stable")
        ids, away = np.take_along_axis(ids, order, 1), np.take_along_axis(away, order, 1)
        over = (ids >= 0).sum(1) > links
        graph[part[~over]] = ids[~over][:, :links]
        if over.any():
            graph[part[over]] = chosen(points, part[over], ids[over], away[over], links)


class Graph:
    """points in order of falling level; graphs[l] has a row for each of the first
    len(graphs[l]) points."""

    def __init__(self, points: np.ndarray, graphs: list[np.ndarray]):
        self.points, self.graphs = points, graphs

    @classmethod
    def built(cls, points: np.ndarray, level: np.ndarray, links: int = LINKS, ef: int = BUILD_EF) -> Graph:
        """points in order of falling level."""
        made = cls(points, [])
        for at in range(int(level[0]) if len(level) else -1, -1, -1):
            n = int((level >= at).sum())
            graph = np.full((n, links if at == 0 else links // 2), -1, np.int32)
            for start in range(0, n, BLOCK):
                block = np.arange(start, min(n, start + BLOCK), dtype=np.int32)
                q = points[block]
                ids = np.broadcast_to(block, (len(block), len(block)))
                norm = np.einsum("ij,ij->i", q, q)
                away = np.maximum(norm[:, None] + norm[None, :] - 2 * (q @ q.T), 0)
                near = np.argsort(away, axis=1, kind="stable")[:, :ef]
                ids, away = np.take_along_axis(ids, near, 1), np.take_along_axis(away, near, 1).astype(np.float32)
                if start:
                    old, far = beam(points[:start], graph[:start], q, np.minimum(made._descend(q), start - 1), ef)
                    ids, away = np.concatenate([ids, old], 1), np.concatenate([away, far], 1)
                    order = np.argsort(away, axis=1, kind="stable")[:, :ef]
                    ids, away = np.take_along_axis(ids, order, 1), np.take_along_axis(away, order, 1)
                graph[block] = chosen(points, block, ids, away, graph.shape[1])
                _linked_back(points, graph, block)
            made.graphs.insert(0, graph)
        return made

    def _descend(self, queries: np.ndarray, stop: int = 0) -> np.ndarray:
        """The point nearest to each query that the levels above `stop` lead to."""
        entries = np.zeros(len(queries), np.int32)
        for graph in reversed(self.graphs[stop:]):
            entries = beam(self.points[: len(graph)], graph, queries, entries, WIDE)[0][:, 0]
        return entries

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Numbers of up to ef points near each query; -1 for none."""
        if len(self.points) <= ef:
            return np.broadcast_to(np.arange(len(self.points), dtype=np.int32), (len(queries), len(self.points)))
        return beam(self.points, self.graphs[0], queries, self._descend(queries, 1), ef)[0]


INDEX = "shard int, dim int, n int, ids binary, starts binary, vectors binary, extra binary, graphs array<binary>"


def build_index(vectors: DataFrame, shard_rows: int = SHARD, links: int = LINKS, ef: int = BUILD_EF) -> DataFrame:
    """One row for each shard and number of components: the distinct vectors (double) in order
    of falling level, the ids of each in order of size, and the graphs. vectors: vec_id, vector."""
    shards = max(1, -(-vectors.count() // shard_rows))
    longest = {r.dim: r.longest for r in vectors.groupBy(F.size("vector").alias("dim")).agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        shard = None
        for batch in batches:
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            ids, flat = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                some, vectors_ = held.setdefault(dim, ([], []))
                some.append(ids[rows])
                vectors_.append(flat[begins[rows][:, None] + np.arange(dim)])
        for dim, (some, parts) in held.items():
            ids, rows = np.concatenate(some).astype(np.int64), np.concatenate(parts) + 0.0  # no negative zero
            distinct, of = np.unique(rows, axis=0, return_inverse=True)
            order = np.lexsort((ids, of.ravel()))
            ids, of = ids[order], of.ravel()[order]
            starts = np.searchsorted(of, np.arange(len(distinct) + 1))
            level = levels(ids[starts[:-1]], links)
            rank = np.argsort(-level, kind="stable")
            grouped = [ids[starts[i] : starts[i + 1]] for i in rank]
            distinct, level = distinct[rank], level[rank]
            extra = np.sqrt(np.maximum(longest[dim] - np.einsum("ij,ij->i", distinct, distinct), 0))
            graph = Graph.built(np.column_stack([distinct, extra]).astype(np.float32), level, links, ef)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(distinct)], pa.int32()),
                "ids": [np.concatenate(grouped).tobytes()], "starts": [np.cumsum([0, *map(len, grouped)]).astype(np.int64).tobytes()],
                "vectors": [distinct.tobytes()], "extra": [extra.tobytes()], "graphs": [[g.tobytes() for g in graph.graphs]],
            })

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    return vectors.select(shard.alias("shard"), "vec_id", "vector").repartitionById(shards, F.col("shard")).mapInArrow(run, INDEX)


class Shard:
    """An index row, read back."""

    def __init__(self, dim: int, n: int, ids: bytes, starts: bytes, vectors: bytes, extra: bytes, graphs: list[bytes], links: int):
        self.ids, self.starts = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64)
        self.vectors = np.frombuffer(vectors).reshape(n, dim)
        points = np.column_stack([self.vectors, np.frombuffer(extra)]).astype(np.float32)
        self.graph = Graph(points, [np.frombuffer(g, np.int32).reshape(-1, links if i == 0 else links // 2) for i, g in enumerate(graphs)])

    def best(self, qids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query's id, id, score of each query's k best."""
        met = self.graph.search(np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32), ef)
        rows, columns = np.nonzero(met >= 0)
        points = met[rows, columns]
        score = np.zeros(len(rows))
        for i in range(queries.shape[1]):  # added in order, as a plain sum would
            score += queries[rows, i] * self.vectors[points, i]
        # a point stands for its first k + 1 ids, which may hold the query's own
        many = np.minimum(self.starts[points + 1] - self.starts[points], k + 1)
        place = np.repeat(np.cumsum(many) - many, many)
        ids = self.ids[np.repeat(self.starts[points], many) + np.arange(many.sum()) - place]
        rows, score = np.repeat(rows, many), np.repeat(score, many)
        other = ids != qids[rows]
        rows, score, ids = rows[other], score[other], ids[other]
        order = np.lexsort((ids, -score, rows))
        rows, score, ids = rows[order], score[order], ids[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
        return qids[rows[keep]], ids[keep], score[keep]


def search(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = SEARCH_EF, links: int = LINKS) -> DataFrame:
    """query_id, rank, vec_id, score. index: a written index; queries: vec_id, vector."""
    shards = index.agg(F.max("shard")).first()[0]
    shards = 1 if shards is None else shards + 1
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("vec_id").alias("query_id"), "vector")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("dim", "int"), ("n", "int"), ("ids", "binary"), ("starts", "binary"), ("vectors", "binary"), ("extra", "binary"), ("graphs", "array<binary>"))]
    both = index.select("shard", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("vector"), "dim", "n", "ids", "starts", "vectors", "extra", "graphs").unionByName(asked.select("shard", "query_id", "vector", *none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Shard] = {}
        for batch in batches:
            numbers = batch.column("query_id").to_pylist()
            waiting: dict[int, tuple[list, list]] = {}
            for i, number in enumerate(numbers):
                if number is None:  # indexes come first
                    dim, *rest = (batch.column(c)[i].as_py() for c in ("dim", "n", "ids", "starts", "vectors", "extra", "graphs"))
                    held[dim] = Shard(dim, *rest, links)
                else:
                    vector = batch.column("vector")[i].values.to_numpy(zero_copy_only=False)
                    if len(vector) in held:
                        ids, vectors = waiting.setdefault(len(vector), ([], []))
                        ids.append(number)
                        vectors.append(vector)
            for dim, (ids, vectors) in waiting.items():
                for start in range(0, len(ids), BLOCK):
                    found = held[dim].best(np.array(ids[start : start + BLOCK], np.int64), np.array(vectors[start : start + BLOCK]), k, ef)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    met = both.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("query_id").asc_nulls_first())
    scored = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", shard_rows: int = SHARD, links: int = LINKS, build_ef: int = BUILD_EF, ef: int = SEARCH_EF) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, the k other rows
    found with the largest inner products."""
    vectors = persist(usable(table.select("vec_id", vector), vector), "vectors")
    index = persist(build_index(vectors, shard_rows, links, build_ef), "index")
    return search(index, vectors.filter(is_query), k, ef, links)
